"""Drawings and model scores made from the relational test tables, for queries that SQL can check independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom.session import ship

#: Orders whose number is a multiple of this lack the closing tag.
OPEN_EVERY = 10
#: Examples whose number is a multiple of this have no score of one model.
UNRENDERED_EVERY = 11
MODELS = ["base", "fine_tuned", "gpt", "gemini"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawings(spark: SparkSession, sf_dir: str, close: bool = False) -> DataFrame:
    """One drawing for each order with lines: o_orderkey, dataset (priority), split (status) and svg, with one shape for each line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    size = F.col("l_quantity").cast("int")
    shape = (
        F.when(F.col("l_returnflag") == "A", F.format_string('<rect x="%d" y="2" width="%d" height="4" fill="#ff0000"/>', F.col("l_linenumber"), size))
        .when(F.col("l_returnflag") == "N", F.format_string('<line x1="0" y1="%d" x2="%d" y2="9" stroke="#0066ff"/>', F.col("l_linenumber"), size))
        .otherwise(F.format_string('<path d="M %d 1 L %d 20 L 3 9 Z" fill="#00aa55"/>', F.col("l_linenumber"), size))
    )
    body = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", shape.alias("shape")))).alias("s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split"))
    end = F.lit("</svg>") if close else F.when(F.col("o_orderkey") % OPEN_EVERY == 0, "  ").otherwise("</svg>")
    shapes = F.array_join(F.transform("s", lambda x: x["shape"]), "")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="60" height="30">'), shapes, end)
    return orders.join(body, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "dataset", "split", svg.alias("svg"))


#: The shape counts of those drawings, without any XML.
DRAWINGS_SQL = """
SELECT o_orderkey, any_value(o_orderpriority) AS dataset, any_value(o_orderstatus) AS split,
    count(*) FILTER (l_returnflag = 'A') AS basic, count(*) FILTER (l_returnflag = 'N') AS connector, count(*) FILTER (l_returnflag = 'R') AS complex
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluation_index, model and pixel_mse: four price columns of a line stand for four models."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("evaluation_index")).agg(F.max("l_discount").alias("base"), F.max("l_tax").alias("fine_tuned"), (F.max("l_quantity") / 500).alias("gpt"), F.min("l_discount").alias("gemini"))
    lines = lines.withColumn("gpt", F.when(F.col("evaluation_index") % UNRENDERED_EVERY != 0, F.col("gpt")))
    return lines.select("evaluation_index", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pixel_mse")) for m in MODELS])))


SCORES_SQL = f"""
SELECT l_orderkey AS evaluation_index, unnest(['base', 'fine_tuned', 'gpt', 'gemini']) AS model,
    unnest([max(l_discount), max(l_tax), CASE WHEN l_orderkey % {UNRENDERED_EVERY} <> 0 THEN max(l_quantity) / 500 END, min(l_discount)]) AS pixel_mse
FROM lineitem GROUP BY l_orderkey
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results from events: what kind of event it is says how far the prediction came."""
    e = table(spark, sf_dir, "events")
    kind = F.crc32(F.col("event_type").cast("binary")) % 3
    number = F.col("event_id") % 7
    return e.select(
        F.col("event_id").alias("evaluation_index"), F.col("event_type").alias("model"), (number > 0).alias("prediction_has_svg"), (number > 1).alias("prediction_is_valid_svg"),
        (number > 2).alias("prediction_rendered"), F.when(number > 2, F.col("value") / 1000).alias("pixel_mse"), (F.col("user_id") % 50 / 10).alias("latency_seconds"), kind.alias("kind"),
    )


RESULTS_SQL = """
SELECT event_id AS evaluation_index, event_type AS model, event_id % 7 > 0 AS prediction_has_svg, event_id % 7 > 1 AS prediction_is_valid_svg,
    event_id % 7 > 2 AS prediction_rendered, CASE WHEN event_id % 7 > 2 THEN value / 1000 END AS pixel_mse, user_id % 50 / 10 AS latency_seconds
FROM events
"""

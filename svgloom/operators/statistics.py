"""Counts of shapes by source and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom.functions import markup, native

SUMS = ("basic_count", "connector_count", "complex_count")


def counted(df: DataFrame, svg: str = "svg") -> DataFrame:
    """``df`` with ``shapes`` (ok and three counts): one Arrow stage; keep what goes in narrow."""
    return df.withColumn("shapes", markup.counts(F.col(svg)))


def primitive_statistics(counted_rows: DataFrame, by: str = "dataset", split: str = "split") -> DataFrame:
    """A row for each source and split and one, split ``all``, for each source; shares come from summed counts. A row that does not parse counts as a row and an error only."""
    sums = [F.coalesce(F.sum(f"shapes.{c}"), F.lit(0)).cast("long").alias(f"{c}_count") for c in ("basic", "connector", "complex")]
    grouped = counted_rows.select(by, split, "shapes").rollup(by, split).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("shapes.ok")).alias("parse_errors"), *sums, F.grouping(by).alias("__total"), F.grouping(split).alias("__all"))
    out = grouped.where("__total = 0").withColumn(split, F.when(F.col("__all") == 1, "all").otherwise(F.col(split)))
    simple = F.col("basic_count") + F.col("connector_count")
    geometric = simple + F.col("complex_count")
    return out.select(
        F.col(by).alias("dataset"), F.col(split).alias("split"), "rows", "parse_errors", "basic_count", "connector_count",
        simple.alias("simple_count"), "complex_count", geometric.alias("geometric_count"),
        native.ratio(F.col("basic_count"), geometric).alias("basic_pct"), native.ratio(F.col("connector_count"), geometric).alias("connector_pct"),
        native.ratio(simple, geometric).alias("simple_pct"), native.ratio(F.col("complex_count"), geometric).alias("complex_pct"),
        native.ratio(geometric, F.col("rows") - F.col("parse_errors")).alias("avg_geometric_per_row"),
    )


def split_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def kept_counts(df: DataFrame, kept: str, by: str = "split") -> DataFrame:
    """Rows kept and removed in each split."""
    return df.groupBy(by).agg(F.count_if(F.col(kept)).alias("kept"), F.count_if(~F.coalesce(F.col(kept), F.lit(False))).alias("removed"))

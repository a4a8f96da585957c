"""The queries of the library and their DuckDB SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom import config
from svgloom.functions import markup, native
from svgloom.operators import batches, captions, evaluation, repair, sampling, splits, statistics
from svgloom.plans import carriers
from svgloom.plans.carriers import DRAWINGS_SQL, MODELS, RESULTS_SQL, SCORES_SQL, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _digits(c: str, n: int = 9):
    return F.round(c, n).alias(c)


# --- statistics and quality -------------------------------------------------------------------------

_PART = "CASE WHEN {w} = 0 THEN 0.0 ELSE round({p} / {w}, 9) END"


@query(f"""
WITH d AS ({DRAWINGS_SQL}), e AS (SELECT *, o_orderkey % {carriers.OPEN_EVERY} = 0 AS bad FROM d),
r AS (SELECT dataset, coalesce(split, 'all') AS split, count(*) AS rows, count(*) FILTER (bad) AS parse_errors,
    coalesce(sum(basic) FILTER (NOT bad), 0)::BIGINT AS b, coalesce(sum(connector) FILTER (NOT bad), 0)::BIGINT AS c, coalesce(sum(complex) FILTER (NOT bad), 0)::BIGINT AS x
    FROM e GROUP BY GROUPING SETS ((dataset, split), (dataset)))
SELECT dataset, split, rows, parse_errors, b AS basic_count, c AS connector_count, b + c AS simple_count, x AS complex_count, b + c + x AS geometric_count,
    {_PART.format(p="b", w="(b + c + x)")} AS basic_pct, {_PART.format(p="c", w="(b + c + x)")} AS connector_pct, {_PART.format(p="(b + c)", w="(b + c + x)")} AS simple_pct,
    {_PART.format(p="x", w="(b + c + x)")} AS complex_pct, {_PART.format(p="(b + c + x)", w="(rows - parse_errors)")} AS avg_geometric_per_row
FROM r
""")
def svg_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = statistics.counted(carriers.drawings(spark, sf_dir).select("dataset", "split", "svg"))
    out = statistics.primitive_statistics(counted)
    return out.select(*[_digits(c) if c.endswith("_pct") or c.startswith("avg") else c for c in out.columns])


_SHARE = "(basic + connector) / nullif(basic + connector + complex, 0)"
_REASON = f"""CASE WHEN basic + connector + complex = 0 THEN 'SVG quality filter failed: no geometric elements found.'
    WHEN {_SHARE} < 0.4 THEN 'SVG quality filter failed: structural primitive ratio ' || printf('%.2f', {_SHARE}) || ' < 0.40.'
    WHEN complex > 50 THEN 'SVG quality filter failed: complex shape count ' || complex || ' > 50.' END"""


@query(f"SELECT o_orderkey, ({_REASON}) AS error, ({_REASON}) IS NULL AS keep FROM ({DRAWINGS_SQL})")
def svg_quality_filter(spark, sf_dir):
    return _quality(spark, sf_dir, "o_orderkey")


def _quality(spark, sf_dir, *columns):
    c = F.col("clean")
    rows = carriers.drawings(spark, sf_dir).select(*columns, markup.cleaned(F.col("svg")).alias("clean"))
    error = F.coalesce(c["error"], native.quality_error(c["basic"], c["connector"], c["complex"]))
    return rows.select(*columns, error.alias("error"), error.isNull().alias("keep"))


@query(f"""SELECT o_orderkey, o_orderkey % {carriers.OPEN_EVERY} = 0 AS was_open, 1 AS closers FROM ({DRAWINGS_SQL})""")
def close_repair(spark, sf_dir):
    d = carriers.drawings(spark, sf_dir)
    closed = native.closed_svg(F.col("svg"))
    return d.select("o_orderkey", (closed != F.col("svg")).alias("was_open"), F.regexp_count(closed, F.lit("</svg>")).alias("closers"))


@query(f"""WITH d AS ({DRAWINGS_SQL}), k AS (SELECT *, ({_REASON}) IS NULL AS keep FROM d)
SELECT dataset, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed FROM k GROUP BY dataset""")
def kept_by_source(spark, sf_dir):
    return statistics.kept_counts(_quality(spark, sf_dir, "dataset"), "keep", "dataset")


@query("SELECT o_orderkey, '<svg width=\"1\"><path/></svg>' AS svg FROM orders WHERE o_orderkey % 2 = 1")
def extract_svg(spark, sf_dir):
    text = F.concat(F.lit("Here it is: "), F.when(F.col("o_orderkey") % 2 == 1, '<svg width="1"><path/></svg>').otherwise("<svg><rect/></svg"), F.lit(" done"))
    return table(spark, sf_dir, "orders").select("o_orderkey", native.extracted_svg(text).alias("svg")).where("svg is not null")


# --- splits and packaging ---------------------------------------------------------------------------

_UNIT = "('0x' || substr(sha256('42:' || sha256(text)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
_SPLIT = f"CASE WHEN {_UNIT} < 0.8 THEN 'train' WHEN {_UNIT} < 0.8 + 0.1 THEN 'test' ELSE 'val' END"


@query(f"SELECT doc_id, sha256(text) AS digest, {_SPLIT} AS split FROM documents")
def hash_split(spark, sf_dir):
    d = splits.with_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", native.digest(F.col("text")).alias("digest"), "split")


@query(f"SELECT source, {_SPLIT} AS split, count(*) AS rows FROM documents GROUP BY ALL")
def split_counts(spark, sf_dir):
    return statistics.split_counts(splits.with_split(table(spark, sf_dir, "documents").select("source", "text"), "text"), "source", "split")


_SOURCE = "(SELECT text, CASE doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents)"
_REPAIR = "(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark)"
_LOOKUP = f"(SELECT sha256(text) AS digest, min(CASE split WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END) AS p FROM {_SOURCE} GROUP BY 1)"


def _source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text", F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 5 == 1, "test").otherwise("train").alias("split"))


def _targets(spark, sf_dir):
    """Documents, which all have a split, and benchmark items, which have none."""
    items = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("id"), "text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(items)


@query(f"SELECT id, ['train', 'test', 'val'][p] AS split FROM {_REPAIR} JOIN {_LOOKUP} ON digest = sha256(text)")
def split_propagation(spark, sf_dir):
    lookup = splits.split_lookup(_source(spark, sf_dir), "text")
    return splits.follow_split(_targets(spark, sf_dir), lookup, "text").select("id", "split")


@query(f"SELECT count(DISTINCT sha256(text)) AS missing FROM {_REPAIR} WHERE sha256(text) NOT IN (SELECT digest FROM {_LOOKUP})")
def missing_targets(spark, sf_dir):
    return splits.missing_targets(_targets(spark, sf_dir), splits.split_lookup(_source(spark, sf_dir), "text"), "text")


@query("SELECT doc_id, doc_id % 4 = 0 AS is_truncated FROM documents")
def truncation_folder(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 4 == 0, "truncation/hard").when(F.col("doc_id") % 4 == 1, "not_truncation/hard").otherwise("medium")
    path = native.path(folder, native.chunk_name(F.floor(F.col("doc_id") / 100), 8))
    return table(spark, sf_dir, "documents").select("doc_id", native.in_truncation_folder(path).alias("is_truncated"))


# --- sampling, ranges and limits --------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 150")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 150, seed=7)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 9 AS row_index FROM orders")
def row_numbers(spark, sf_dir):
    return sampling.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", start=10).select("o_orderkey", "row_index")


@query("SELECT o_orderkey, (o_orderkey // 100)::BIGINT AS chunk FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 650")
def take_range(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("row_index"))
    return sampling.row_range(d, 50, 900, 600).select("o_orderkey", sampling.chunk_of(F.col("row_index"), 100).alias("chunk"))


@query("""SELECT o_orderpriority, o_orderkey, keep FROM (SELECT o_orderpriority, o_orderkey, o_orderkey % 3 <> 0 AS keep,
    coalesce(sum((o_orderkey % 3 <> 0)::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 40""")
def target_cap(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.col("o_orderkey").alias("row_index"), (F.col("o_orderkey") % 3 != 0).alias("keep"))
    return captions.until_target(d, 40, ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", "keep")


@query("SELECT count(DISTINCT o_orderkey // 1000) AS chunks, count(*) AS rows, count(*) FILTER (o_orderkey % 3 <> 0) AS kept FROM orders")
def chunk_state(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(sampling.chunk_of(F.col("o_orderkey"), 1000).alias("chunk"), (F.col("o_orderkey") % 3 != 0).alias("keep"))
    return captions.checkpoint_state(d)


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) - 1) % 2 AS half FROM documents")
def stratified_halves(spark, sf_dir):
    return sampling.halves(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")


@query("""WITH s AS (SELECT source, greatest(round_even(count(*) * 0.1, 0), 1) AS k FROM documents GROUP BY source),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source FROM r JOIN s USING (source) WHERE r <= k""")
def truncation_pick(spark, sf_dir):
    return sampling.fraction_picks(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 0.1).select("doc_id", "source")


_LENGTH = "len(regexp_extract_all(text, '[^ \\n]+'))"


@query(f"SELECT doc_id FROM documents WHERE {_LENGTH} <= 400 ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100")
def evaluation_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[^ \\n]+")).alias("sequence_length"))
    return sampling.first_fitting(d, "doc_id", "sequence_length", 100, most=400).select("doc_id")


@query(f"SELECT source, count(*) FILTER ({_LENGTH} <= 300) AS kept, count(*) FILTER ({_LENGTH} > 300) AS removed FROM documents GROUP BY source")
def sequence_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.regexp_count("text", F.lit("[^ \\n]+")) <= 300).alias("fits"))
    return statistics.kept_counts(d, "fits", "source")


@query("""SELECT o_custkey AS run, path, step, place FROM (SELECT o_custkey, 'checkpoint-' || o_orderkey AS path, o_orderkey AS step,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) WHERE place <= 3""")
def retain_last_k(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("checkpoint-"), "o_orderkey").alias("path"))
    return sampling.retained(d).select("run", "path", "step", "place")


@query("SELECT 'checkpoint-' || max(o_orderkey) AS path, max(o_orderkey) AS step FROM orders")
def latest_checkpoint(spark, sf_dir):
    return sampling.latest(table(spark, sf_dir, "orders").select(F.concat(F.lit("checkpoint-"), "o_orderkey").alias("path")))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def resume_antijoin(spark, sf_dir):
    return captions.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


# --- scalars ----------------------------------------------------------------------------------------


@query("""SELECT doc_id, printf('animal_illustrations_train_%06d.svg', doc_id) AS made, coalesce(lang, 'None') AS named,
    concat_ws('/', 'out', source, printf('chunk_%06d', doc_id // 100)) AS folder FROM documents""")
def source_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = native.source_filename("animal_illustrations", F.lit("train"), F.col("doc_id"), None)
    named = native.source_filename("svgx_core", F.lit("train"), F.col("doc_id"), F.col("lang"))
    return d.select("doc_id", made.alias("made"), named.alias("named"), native.path("out", F.col("source"), native.chunk_name(F.floor(F.col("doc_id") / 100))).alias("folder"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2.5 WHEN 1 THEN (event_id % 900) / 1000 WHEN 2 THEN (event_id % 20) + 0.5
    ELSE least(0.5 * pow(2, event_id % 9), 8) END AS seconds, event_id % 600 IN (429, 500, 502, 503, 504) AS again FROM events""")
def retry_after(spark, sf_dir):
    e, k = table(spark, sf_dir, "events").select("event_id"), F.col("event_id") % 4
    message = F.when(k == 1, F.format_string("please try again in %dms", F.col("event_id") % 900)).when(k == 2, F.format_string("Try again in %d.5s.", F.col("event_id") % 20)).otherwise("busy")
    return e.select("event_id", native.retry_seconds(F.when(k == 0, "2.5"), message, F.col("event_id") % 9).alias("seconds"), native.retryable(F.col("event_id") % 600).alias("again"))


@query("""SELECT p_partkey, p_size + 0.5 AS number, 'data:image/png;base64,' || base64(p_name::BLOB) AS url, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE p_type END AS kind,
    printf('%.1f%%', p_size / 50 * 100) AS share, CASE WHEN p_size < 25 THEN 1 WHEN p_size < 37.5 THEN 2 ELSE 3 END AS corruptions FROM part""")
def scalar_mix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    number = native.first_number(F.concat(F.lit("x="), (F.col("p_size") + 0.5).cast("string"), F.lit("px 7")), 0.0)
    kind = native.or_default(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), "none")
    u = F.col("p_size") / 50
    return p.select("p_partkey", number.alias("number"), native.data_url(F.col("p_name").cast("binary")).alias("url"), kind.alias("kind"), native.percent(u).alias("share"), native.corruption_count(u).alias("corruptions"))


@query("""SELECT p_partkey, 'system' AS first_role, 'user' AS last_role, 'Repair this corrupted SVG so it matches the image. Return only the corrected SVG markup.' || chr(10) || chr(10) || p_name AS request,
    'Generate valid SVG markup for this image.' AS drawing, p_name AS plain FROM part""")
def prompts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    system, image = config.SYSTEM_MESSAGE, F.lit("image")
    r, i, t = native.repair_prompt(system, image, F.col("p_name")), native.image_prompt(system, image), native.text_prompt(system, F.col("p_name"))
    return p.select("p_partkey", r[0]["role"].alias("first_role"), r[1]["role"].alias("last_role"), r[1]["content"][0]["text"].alias("request"), i[1]["content"][0]["text"].alias("drawing"), t[1]["content"][0]["text"].alias("plain"))


# --- images as arrays -------------------------------------------------------------------------------

_PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query(f"SELECT a.vec_id, round(list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) FOR x IN list_zip(a.embedding, b.embedding)]) / 64, 9) AS mse {_PAIR}")
def pair_mse(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    wide = [F.transform(c, lambda x: x.cast("double")) for c in ("embedding", "other")]
    return d.select("vec_id", F.round(native.pixel_mse(*wide, scale=1.0), 9).alias("mse"))


@query(f"""SELECT a.vec_id, len([p FOR p IN range(16) IF list_max([abs(a.embedding[4 * p + k]::DOUBLE - b.embedding[4 * p + k]::DOUBLE) FOR k IN [1, 2, 3, 4]]) >= 0.3]) / 16 AS share {_PAIR}""")
def changed_ratio(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    wide = [F.transform(c, lambda x: x.cast("double")) for c in ("embedding", "other")]
    return d.select("vec_id", native.changed_share(*wide, channels=4, least=0.3).alias("share"))


@query(f"""WITH m AS (SELECT a.vec_id, list_sum([power((x[1]::DOUBLE - x[2]::DOUBLE) / 10, 2) FOR x IN list_zip(a.embedding, b.embedding)]) / 64 AS mse {_PAIR})
SELECT vec_id, CASE WHEN mse < 0.0003 THEN 'render MSE ' || printf('%.6f', mse) || ' < 0.000300' END AS error FROM m""")
def acceptance(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    wide = [F.transform(c, lambda x: x.cast("double")) for c in ("embedding", "other")]
    return d.select("vec_id", native.acceptance_error(native.pixel_mse(*wide, scale=10.0), F.lit(1.0), least_mse=0.0003).alias("error"))


# --- evaluation -------------------------------------------------------------------------------------


@query(f"""SELECT model, count(*) AS examples, avg(prediction_has_svg::INT) AS svg_rate, avg(prediction_is_valid_svg::INT) AS valid_rate, avg(prediction_rendered::INT) AS render_rate,
    count(pixel_mse) AS mse_count, round(avg(pixel_mse), 9) AS mean_pixel_mse FROM ({RESULTS_SQL}) GROUP BY model""")
def eval_summary(spark, sf_dir):
    out = evaluation.summarized(carriers.results(spark, sf_dir), "model")
    return out.select(*[_digits(c) if c == "mean_pixel_mse" else c for c in out.columns])


@query(f"SELECT model, round(avg(latency_seconds), 9) AS mean_latency_seconds, round(avg(coalesce(pixel_mse, 1.0)), 9) AS coverage_penalized_mse FROM ({RESULTS_SQL}) GROUP BY model")
def penalized_mean(spark, sf_dir):
    out = evaluation.provider_summary(carriers.results(spark, sf_dir), "model")
    return out.select("model", _digits("mean_latency_seconds"), _digits("coverage_penalized_mse"))


_WON = f"""(SELECT evaluation_index, model AS winner FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_index
    ORDER BY pixel_mse, list_position({MODELS}, model)) AS r FROM ({SCORES_SQL}) WHERE pixel_mse IS NOT NULL) WHERE r = 1)"""


@query(f"SELECT evaluation_index, winner FROM {_WON}")
def winner(spark, sf_dir):
    return evaluation.winners(carriers.scores(spark, sf_dir), MODELS).select("evaluation_index", "winner")


@query(f"""SELECT model, round(avg(pixel_mse), 9) AS mean_mse, round(median(pixel_mse), 9) AS median_mse, coalesce(any_value(w.n), 0)::BIGINT AS wins
FROM ({SCORES_SQL}) LEFT JOIN (SELECT winner, count(*) AS n FROM {_WON} GROUP BY winner) w ON winner = model GROUP BY model""")
def model_compare(spark, sf_dir):
    return evaluation.model_summary(carriers.scores(spark, sf_dir), MODELS).select("model", _digits("mean_mse"), _digits("median_mse"), "wins")


@query(f"""WITH s AS ({SCORES_SQL}) SELECT a.model AS first, b.model AS second, count(*) FILTER (a.pixel_mse < b.pixel_mse) AS first_wins, count(*) FILTER (b.pixel_mse < a.pixel_mse) AS second_wins
FROM s a JOIN s b ON a.evaluation_index = b.evaluation_index AND list_position({MODELS}, a.model) < list_position({MODELS}, b.model) GROUP BY ALL""")
def pairwise_wins(spark, sf_dir):
    return evaluation.pairwise_wins(carriers.scores(spark, sf_dir), MODELS)


@query(f"SELECT evaluation_index, {', '.join(f'''max(pixel_mse) FILTER (model = '{m}') AS {m}_mse''' for m in MODELS)} FROM ({SCORES_SQL}) GROUP BY evaluation_index")
def wide_results(spark, sf_dir):
    return evaluation.wide(carriers.scores(spark, sf_dir), MODELS)


@query("""WITH t AS (SELECT event_type AS task, avg(value) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 50 GROUP BY 1)
SELECT task, round(loss, 9) AS loss FROM t UNION ALL SELECT 'all', round(avg(loss), 9) FROM t""")
def macro_validation(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("batch"), F.col("value").alias("loss"))
    return evaluation.macro_validation(d, 50).select("task", _digits("loss"))


@query(f"SELECT evaluation_index FROM ({SCORES_SQL}) WHERE pixel_mse > 0.01 GROUP BY 1 HAVING count(*) = 4")
def common_examples(spark, sf_dir):
    s = carriers.scores(spark, sf_dir).withColumn("pixel_mse", F.when(F.col("pixel_mse") > 0.01, F.col("pixel_mse")))
    return evaluation.common_examples(s, MODELS)


# --- token batches ----------------------------------------------------------------------------------

_TURNS = "(SELECT role, conv_id, turn, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS r, count(*) OVER (PARTITION BY role) AS n FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"""SELECT role, conv_id, turn, e.epoch::INT AS epoch, (e.epoch - 1) * n + r AS step, ((e.epoch - 1) * n + r) * 2 + (role = 'assistant')::INT AS turn_place
FROM {_TURNS}, (SELECT unnest(range(1, 1001)) AS epoch) e WHERE (e.epoch - 1) * n + r < 400""")
def interleave_tasks(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn")
    out = batches.interleaved(d.withColumnRenamed("turn", "t"), 400, ["user", "assistant"], "role", "conv_id", "t")
    return out.select("role", "conv_id", F.col("t").alias("turn"), "epoch", "step", F.col("turn").alias("turn_place"))


@query("""WITH a AS (SELECT l_orderkey, list(l_suppkey::INT ORDER BY l_linenumber, l_partkey, l_suppkey) AS target, list((l_partkey % 97)::INT ORDER BY l_linenumber, l_partkey, l_suppkey) AS prompt FROM lineitem GROUP BY 1),
b AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey) - 1) // 4 AS batch_id, l_orderkey % 8 AS shard, list_concat(prompt, target) AS ids FROM a),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY shard, batch_id) AS most FROM b)
SELECT l_orderkey, batch_id, list_concat(ids, [0 FOR x IN range(most - len(ids))]) AS input_ids,
    list_concat([-100 FOR x IN range(len(prompt))], target, [-100 FOR x IN range(most - len(ids))]) AS labels,
    list_concat([1 FOR x IN range(len(ids))], [0 FOR x IN range(most - len(ids))]) AS attention_mask FROM m""")
def pad_batch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    rows = rows.select("l_orderkey", (F.col("l_orderkey") % 8).alias("shard"), F.transform("s", lambda x: (x["l_partkey"] % 97).cast("int")).alias("prompt_ids"), F.transform("s", lambda x: x["l_suppkey"].cast("int")).alias("target_ids"))
    batched = batches.batched(batches.training_arrays(rows), 4, "l_orderkey", by=("shard",)).withColumn("__b", F.struct("shard", "batch_id"))
    out = batches.padded(batched, {"input_ids": 0, "labels": config.IGNORED_LABEL, "attention_mask": 0}, by="__b")
    return out.select("l_orderkey", "batch_id", "input_ids", "labels", "attention_mask")


# --- corruption -------------------------------------------------------------------------------------


def _repaired(spark, sf_dir, levels=config.LEVELS):
    d = carriers.drawings(spark, sf_dir, close=True)
    rows = d.select(F.col("o_orderkey").alias("row_index"), F.format_string("%d.svg", F.col("o_orderkey")).alias("filename"), "svg", "dataset")
    return repair.repair_rows(rows, levels)


@query()
def corruption_engine(spark, sf_dir):
    return _repaired(spark, sf_dir)


@query()
def truncated_engine(spark, sf_dir):
    """Of the hard level only, so no other level is made: seeds do not depend on it."""
    rows = _repaired(spark, sf_dir, ("hard",))
    return repair.truncated_rows(rows.withColumn("key", F.regexp_extract("filename", r"\d+", 0).cast("long")), "key", 1000)

"""More queries with SQL: readers and writers, captions, markup, faults, packaging, tasks. Registered beside those of the catalog."""

from __future__ import annotations

import functools
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.functions import corrupt, markup, native, raster
from svgloom.operators import batches, captions, evaluation, predictions, repair, sampling, splits, statistics, tasks
from svgloom.plans import carriers
from svgloom.plans.carriers import DRAWINGS_SQL, MODELS, SCORES_SQL, table
from svgloom.plans.catalog import query
from svgloom.session import materialize, new_folder, spread
from svgloom.sources import sinks, tables
from svgloom.streaming import incremental

# --- readers and writers ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS row_index, 'o' || o_orderkey AS filename, 'concise' AS caption_style, 'key' AS dataset, o_orderkey % 3 <> 0 AS keep, (o_orderkey // 4000)::BIGINT AS chunk FROM orders")
def checkpoint_chunks(spark, sf_dir):
    """Chunks are written one by one, the older ones without a caption style, and read with defaults."""
    root = new_folder(spark, "chunks")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), F.concat(F.lit("o"), "o_orderkey").alias("filename"), F.lit("<svg/>").alias("svg"), (F.col("o_orderkey") % 3 != 0).alias("keep"))
    rows = schemas.conform(o, schemas.CHECKPOINT)
    chunk = sampling.chunk_of(F.col("row_index"), 4000)
    last = rows.agg(F.max(chunk)).first()[0]
    for n in range(last + 1):
        part = rows.where(chunk == n)
        sinks.save_chunk(part.drop("caption_style") if n % 2 else part, root, n)
    return tables.chunks(spark, root, "key").select("row_index", "filename", "caption_style", "dataset", "keep", "chunk")


@query("SELECT doc_id, ['train', 'test'][1 + (doc_id % 2)::INT] AS split, 'val' AS missing FROM documents")
def stored_splits(spark, sf_dir):
    """A table with a folder for each split; the union of those that are there, and which are not."""
    root = new_folder(spark, "splits")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("s"))
    for n, name in enumerate(("train", "test")):
        sinks.save(d.where(F.col("s") == n).drop("s"), f"{root}/{name}")
    found, missing = tables.present_splits(spark, root)
    return found.withColumn("missing", F.lit(",".join(missing)))


@query("SELECT n_nationkey, 'train' AS split, false AS older FROM nation UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'val' ELSE 'test' END, true FROM documents")
def stored_tables(spark, sf_dir):
    """A table without a split column counts as train; one saved by splits keeps them; the first path that exists is read."""
    root = new_folder(spark, "tables")
    sinks.save(table(spark, sf_dir, "nation").select("n_nationkey"), f"{root}/new")
    sinks.save_splits(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("test").alias("split")), f"{root}/old")
    new = tables.dataset(spark, tables.first_existing(spark, f"{root}/new", f"{root}/old")).withColumn("older", F.lit(False))
    old = tables.dataset(spark, tables.first_existing(spark, f"{root}/nothing", f"{root}/old")).withColumn("older", F.lit(True))
    return new.select("n_nationkey", "split", "older").union(old.select("doc_id", "split", "older"))


@query("SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'train' ELSE 'test' END AS split FROM documents)) WHERE r <= 60")
def sampled_splits(spark, sf_dir):
    """The seeded sample of each split of a source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").when(F.col("doc_id") % 3 == 1, "train").otherwise("test").alias("split"))
    return tables.sample(spark, d, config.source("starvector_emoji"), "doc_id", 60).select("doc_id", "split")


@query("SELECT doc_id FROM documents WHERE source IN ('src0', 'src3', 'src5')")
def source_subset(spark, sf_dir):
    return tables.of_sources(table(spark, sf_dir, "documents"), ("src0", "src3", "src5"), "source").select("doc_id")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS output_index, item_id AS evaluation_index, 'f' || item_id AS filename, length(text) AS n, item_id % 2 = 0 AS has_text FROM benchmark")
def manifest_results(spark, sf_dir):
    """A manifest and a result file for each example, both JSON; examples with their results in order."""
    root = new_folder(spark, "manifest")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n")).orderBy("item_id").collect()
    listed = [{"evaluation_index": r.item_id, "filename": f"f{r.item_id}"} for r in items]
    sinks.write_text(spark, f"{root}/manifest.json", json.dumps({"tasks": {"text": [], "image": listed}}))
    for k, r in enumerate(items):
        sinks.write_text(spark, f"{root}/out/{k:04d}/result.json", json.dumps({"evaluation_index": r.item_id, "pixel_mse": float(r.n), "prediction_has_svg": r.item_id % 2 == 0}))
    got = tables.results(spark, f"{root}/out/*/result.json").select("output_index", F.col("pixel_mse").cast("long").alias("n"), F.col("prediction_has_svg").alias("has_text"))
    return evaluation.assembled(evaluation.manifest_examples(tables.manifest(spark, f"{root}/manifest.json")), got)


@query("SELECT item_id AS evaluation_index, printf('%04d', item_id) AS folder FROM benchmark")
def manifest_artifacts(spark, sf_dir):
    """Examples with the paths of their target files."""
    root = new_folder(spark, "artifacts")
    ids = [r.item_id for r in table(spark, sf_dir, "benchmark").select("item_id").collect()]
    sinks.write_text(spark, f"{root}/m.json", json.dumps({"tasks": {"image": [{"evaluation_index": i, "filename": "f"} for i in ids]}}))
    for i in ids:
        for kind in ("png", "svg"):
            sinks.write_text(spark, f"{root}/a/{i:04d}/target.{kind}", kind)
    got = tables.examples(spark, f"{root}/m.json", f"{root}/a")
    return got.select("evaluation_index", F.regexp_extract("image_path", r"(\d+)/target.png$", 1).alias("folder"))


@query("SELECT source, split, rows FROM (SELECT source, 'all' AS split, count(*) AS rows FROM documents GROUP BY source)")
def replaced_table(spark, sf_dir):
    """A table that is written twice in the same place holds the second one."""
    path = new_folder(spark, "replaced") + "/t"
    d = table(spark, sf_dir, "documents").withColumn("split", F.lit("all"))
    sinks.replace(d.select("source", "split"), path)
    sinks.replace(statistics.split_counts(d, "source", "split"), path)
    return spark.read.parquet(path)


_GEOMETRY = "sum(basic + connector + complex)"


@query(f"""SELECT '| ' || concat_ws(' | ', dataset, split, rows, 0, printf('%.1f%%', b / g * 100), printf('%.1f%%', c / g * 100), printf('%.1f%%', (b + c) / g * 100), printf('%.1f%%', x / g * 100), printf('%.1f', g / rows)) || ' |' AS line
FROM (SELECT dataset, coalesce(split, 'all') AS split, count(*) AS rows, sum(basic) AS b, sum(connector) AS c, sum(complex) AS x, {_GEOMETRY} AS g FROM ({DRAWINGS_SQL}) GROUP BY GROUPING SETS ((dataset, split), (dataset)))""")
def statistics_report(spark, sf_dir):
    """The lines of the report of shapes, as written and read again."""
    root = new_folder(spark, "report")
    d = carriers.drawings(spark, sf_dir, close=True).select("dataset", "split", "svg")
    sinks.write_statistics(statistics.primitive_statistics(statistics.counted(d)), root)
    return spark.read.text(f"{root}/svg_stats.md").where("value LIKE '| %-%'").where("value NOT LIKE '| ---%'").select(F.col("value").alias("line"))


@query(f"""SELECT evaluation_index, {', '.join(f'{m}_mse' for m in MODELS)} FROM (SELECT evaluation_index, {', '.join(f"round(max(pixel_mse) FILTER (model = '{m}'), 9) AS {m}_mse" for m in MODELS)} FROM ({SCORES_SQL}) GROUP BY 1)
WHERE {' AND '.join(f'{m}_mse IS NOT NULL' for m in MODELS)}""")
def comparison_csv(spark, sf_dir):
    """The comparison of models on their common examples as CSV and Markdown, read again."""
    root = new_folder(spark, "comparison")
    scores = carriers.scores(spark, sf_dir)
    common = scores.join(evaluation.common_examples(scores, MODELS), "evaluation_index", "left_semi")
    sinks.write_comparison(evaluation.wide(common, MODELS), evaluation.model_summary(common, MODELS), root, evaluation.pairwise_wins(common, MODELS))
    got = spark.read.option("header", True).schema("evaluation_index long, " + ", ".join(f"{m}_mse double" for m in MODELS)).csv(f"{root}/results.csv")
    return got.select("evaluation_index", *[F.round(f"{m}_mse", 9).alias(f"{m}_mse") for m in MODELS])


@query("SELECT name, count(*) AS files FROM (SELECT unnest(['target.svg', 'prediction.txt', 'result.json', 'target.png', 'prediction.svg', 'prediction.png']) AS name, unnest([0, 0, 0, 0, 1, 2]) AS least, item_id % 3 AS kind FROM benchmark) WHERE kind >= least GROUP BY name")
def example_files(spark, sf_dir):
    """Files of each evaluated example, by name: markup and picture of target and prediction as far as they exist."""
    root = new_folder(spark, "examples")
    kind = F.col("item_id") % 3
    answer = F.when(kind == 2, '<svg width="8" height="8"><rect width="4" height="4"/></svg>').when(kind == 1, "<svg><image/></svg>").otherwise("no drawing")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("output_index"), F.lit("f").alias("filename"), F.lit('<svg width="8" height="8"><rect width="4" height="4"/></svg>').alias("svg"), answer.alias("text"))
    found = predictions.evaluated(rows, raster.NumpyRenderer())
    sinks.save_examples(found.join(rows, "output_index"), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT doc_id AS id, doc_id % 2 = 0 AS keep FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1""")
def new_files_only(spark, sf_dir):
    """Two runs over a growing folder: the second reads the new files only."""
    root = new_folder(spark, "stream")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("keep"))
    for n in (0, 1):
        d.where(F.col("id") % 4 == n).write.mode("append").parquet(f"{root}/in")
        incremental.run_new_files(spark, f"{root}/in", "id long, keep boolean", lambda x: x, f"{root}/out", f"{root}/check")
    return spark.read.parquet(f"{root}/out")


# --- captions ---------------------------------------------------------------------------------------

_SHAPE = """CASE l_returnflag WHEN 'A' THEN printf('<rect x="%d" y="2" width="%d" height="4" fill="#ff0000" />', l_linenumber, l_quantity::INT)
    WHEN 'N' THEN printf('<line x1="0" y1="%d" x2="%d" y2="9" stroke="#0066ff" />', l_linenumber, l_quantity::INT)
    ELSE printf('<path d="M %d 1 L %d 20 L 3 9 Z" fill="#00aa55" />', l_linenumber, l_quantity::INT) END"""
_MARKUP = f"""SELECT l_orderkey AS o_orderkey, '<svg xmlns="http://www.w3.org/2000/svg" width="60" height="30">' || string_agg(shape, '' ORDER BY l_linenumber, l_partkey, shape) || CASE WHEN l_orderkey % {carriers.OPEN_EVERY} = 0 THEN chr(10) ELSE '' END || '</svg>' AS svg
FROM (SELECT *, {_SHAPE} AS shape FROM lineitem) GROUP BY l_orderkey"""
_SHARE = "(basic + connector) / nullif(basic + connector + complex, 0)"
_ERROR = f"""CASE WHEN {_SHARE} < 0.4 THEN 'SVG quality filter failed: structural primitive ratio ' || printf('%.2f', {_SHARE}) || ' < 0.40.'
    WHEN complex > 50 THEN 'SVG quality filter failed: complex shape count ' || complex || ' > 50.' END"""


class _Prompted:
    """A captioner for queries: the first sentence of the prompt."""

    def caption(self, image: bytes, prompt: str) -> str:
        return prompt.split(".")[0]


def _raw(spark, sf_dir):
    return carriers.drawings(spark, sf_dir).select(F.col("o_orderkey").alias("row_index"), F.concat(F.lit("o"), "o_orderkey").alias("filename"), "svg")


@query(f"""SELECT d.o_orderkey AS row_index, 'o' || d.o_orderkey AS filename, CASE WHEN error IS NULL THEN m.svg END AS kept_svg, CASE WHEN error IS NULL THEN 'Describe the image in 3-4 concise sentences' END AS text,
    'concise' AS caption_style, 'vfig_shapes' AS dataset, error IS NULL AS keep, error FROM (SELECT *, {_ERROR} AS error FROM ({DRAWINGS_SQL})) d JOIN ({_MARKUP}) m USING (o_orderkey)""")
def caption_checkpoint(spark, sf_dir):
    """Checkpoint rows of a source without texts: cleaned, checked, rendered and captioned, or refused with a reason."""
    rows = captions.caption_rows(_raw(spark, sf_dir), config.source("vfig_shapes"), "train", captioner=_Prompted(), renderer=raster.NumpyRenderer())
    return rows.withColumn("kept_svg", F.when(F.col("keep"), F.col("svg"))).drop("svg")


@query("SELECT p_partkey AS row_index, 'animal_illustrations_train_' || printf('%06d', p_partkey) || '.svg' AS filename, CASE WHEN p_size % 5 = 0 THEN 'None' ELSE p_name END AS text, 'source_prompt' AS caption_style, 'animal_illustrations' AS dataset FROM part WHERE p_size % 7 <> 0 ORDER BY p_partkey LIMIT 500")
def final_captions(spark, sf_dir):
    """The final table of a source with texts of its own: the first rows that are kept, up to the target, captioned range by range."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    raw = p.select(F.col("p_partkey").alias("row_index"), F.when(size % 7 == 0, "<svg").otherwise("<svg><rect/></svg>").alias("svg"), F.when(size % 5 != 0, F.col("p_name")).alias("prompt"))
    rows = captions.captioned_until(raw, config.source("animal_illustrations"), "train", 500, rows_a_step=400)
    out = captions.final_rows(rows, 500)
    return out.withColumn("row_index", F.regexp_extract("filename", r"(\d+)\.svg$", 1).cast("long")).drop("svg")


@query("SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 2 = 0 THEN 'o' || o_orderkey ELSE 'None' END AS filename, CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderpriority END AS svg, 't' || o_orderkey AS text FROM orders")
def caption_sources(spark, sf_dir):
    """File name, drawing and text of raw rows; what is null is the word None."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("row_index"), F.when(k % 2 == 0, F.concat(F.lit("o"), k)).alias("uuid"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("svg_code"), F.concat(F.lit("t"), k).alias("qwen_caption"))
    return captions.source_rows(o, config.source("svgx_core"), "train")


@query("SELECT style, doc_id, 'Describe the ' || CASE style WHEN 'concise' THEN 'image in 3-4' ELSE 'diagram in 5-7' END AS beginning FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'concise' ELSE 'detailed' END AS style FROM documents)")
def label_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "concise").otherwise("detailed").alias("style"))
    return d.select("style", "doc_id", F.regexp_extract(native.label_prompt(F.col("style")), r"^(\S+ \S+ \S+ \S+ \S+)", 1).alias("beginning"))


# --- markup -----------------------------------------------------------------------------------------

_N = "http://www.w3.org/2000/svg"
_MESSY = {
    0: (f'<svg xmlns="{_N}"><rect width="{{}}"/></svg>', f'<svg xmlns="{_N}"><rect width="{{}}" /></svg>'),
    1: (f'\\x3csvg xmlns="{_N}"\\x3e\\x3crect width="{{}}"/\\x3e\\x3c/svg\\x3e', f'<svg xmlns="{_N}"><rect width="{{}}" /></svg>'),
    2: (f'<svg xmlns="{_N}"><g><rect width="{{}}"/></g>  ', f'<svg xmlns="{_N}"><g><rect width="{{}}" /></g>\n</svg>'),
    3: (f'<svg xmlns="{_N}" width="{{}}"><svg height="2"><path/></svg><rect/></svg>', f'<svg xmlns="{_N}" height="2" width="{{}}"><path /></svg>'),
    4: ("<svg><rect width={}/></svg>", None),
    5: (f'<s:svg xmlns:s="{_N}"><s:RECT width="{{}}"/><s:Line/></s:svg>', f'<svg xmlns="{_N}"><RECT width="{{}}" /><Line /></svg>'),
}


def _messy(column):
    parts = [s.split("{}") for s, _ in _MESSY.values()]
    out = F.lit(None).cast("string")
    for n, (a, b) in enumerate(parts):
        out = F.when(F.col("o_orderkey") % len(parts) == n, F.concat(F.lit(a), F.col("o_orderkey").cast("string"), F.lit(b))).otherwise(out)
    return out.alias(column)


def _sql_text(s: str | None) -> str:
    if s is None:
        return "NULL"
    a, b = ("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in s.split("{}"))
    return f"{a} || o_orderkey || {b}"


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(_MESSY)} {' '.join(f'WHEN {n} THEN {_sql_text(out)}' for n, (_, out) in _MESSY.items())} END AS svg, [1, 1, 1, 0, 0, 1][1 + (o_orderkey % {len(_MESSY)})::INT] AS basic, [0, 0, 0, 0, 0, 1][1 + (o_orderkey % {len(_MESSY)})::INT] AS connector, [0, 0, 0, 1, 0, 0][1 + (o_orderkey % {len(_MESSY)})::INT] AS complex FROM orders")
def clean_markup(spark, sf_dir):
    """Escaped, open, nested, broken and prefixed drawings, cleaned, with their counts."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", _messy("svg")).select("o_orderkey", markup.cleaned(F.col("svg")).alias("c"))
    return d.select("o_orderkey", "c.svg", "c.basic", "c.connector", "c.complex")


@query(f"SELECT o_orderkey, o_orderkey % {len(_MESSY)} IN (0, 3, 5) AS valid FROM orders")
def valid_markup(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", _messy("svg")).select("o_orderkey", markup.valid(F.col("svg")).alias("valid"))


@query("SELECT p_partkey, lower(p_brand) AS local, array_to_string([p_type, p_brand], '+') AS joined, 'concise' AS style FROM part")
def tag_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tag = F.concat(F.lit("{http://x/"), "p_partkey", F.lit("}"), "p_brand")
    return p.select("p_partkey", native.local_tag(tag).alias("local"), native.joined_types(F.array("p_type", "p_brand")).alias("joined"), F.from_json(F.to_json(F.struct(F.lit("concise").alias("style"))), "style string")["style"].alias("style"))


@query("SELECT doc_id, printf('%.2f', doc_id / 8 / 25) AS a, printf('%.1f%%', doc_id / 8 * 100) AS b, printf('%.6f', doc_id / 64 / 1000) AS c, printf('%.2f', doc_id / 200) AS d FROM documents")
def exact_decimals(spark, sf_dir):
    """Numbers as text, with ties to even and the exact binary value."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", native.fixed(k / 8 / 25, 2).alias("a"), native.percent(k / 8).alias("b"), native.fixed(k / 64 / 1000, 6).alias("c"), native.fixed(k / 200, 2).alias("d"))


# --- faults -----------------------------------------------------------------------------------------

_HEAD = f'<svg xmlns="{_N}" width="9" height="9">'
def _changed(fault: str, svg: str, seed: int) -> str:
    """A draw that changes nothing is drawn again, as in the retries of a row."""
    for k in range(100):
        try:
            return corrupt.FAULTS[fault](svg, random.Random(seed * 100 + k), "easy")
        except corrupt.CorruptionError:
            continue
    raise ValueError(f"{fault} never changes the drawing")


#: Drawings in which a fault has one possible result, and that result.
_CERTAIN = {
    "missing_objects": ('<rect width="{}"/>', ""),
    "wrong_z_order": ('<rect width="{}"/><circle r="2"/>', '<circle r="2" /><rect width="{}" />'),
    "primitive_degradation": ('<polygon points="{},1"/>', '<polyline points="0,0 10,10 20,0" fill="none" stroke="#000000" />'),
    "group_flattening": ('<g id="{}"><g><rect/></g></g>', None),
}


@query(" UNION ALL ".join(
    f"SELECT p_partkey, '{name}' AS fault, " + (f"'{_HEAD}<g><rect /></g></svg>'" if name == "group_flattening" else f"'{_HEAD}' || '{out.split('{}')[0]}' || p_partkey || '{out.split('{}')[1]}</svg>'" if "{}" in out else f"'{_HEAD[:-1]}{' /' if not out else ''}>{out}{'</svg>' if out else ''}'") + " AS svg FROM part"
    for name, (_, out) in _CERTAIN.items()))
def certain_faults(spark, sf_dir):
    """Each fault on a drawing where it can do one thing only (of two groups, one inside the other, either may go, and both results read alike here)."""
    @F.pandas_udf("string")
    def run(fault, svg, seed):
        return pd.Series([_changed(f, s, int(k)) for f, s, k in zip(fault, svg, seed)])

    p = table(spark, sf_dir, "part").select("p_partkey")
    rows = None
    for name, (body, _) in _CERTAIN.items():
        a, b = body.split("{}")
        part = p.select("p_partkey", F.lit(name).alias("fault"), F.concat(F.lit(_HEAD + a), F.col("p_partkey").cast("string"), F.lit(b + "</svg>")).alias("svg"))
        rows = part if rows is None else rows.union(part)
    out = rows.select("p_partkey", "fault", run("fault", "svg", "p_partkey").alias("svg"))
    return out.withColumn("svg", F.regexp_replace("svg", ' id="[0-9]+"', ""))


_TRIED = ("missing_objects", "wrong_z_order", "primitive_degradation", "text_corruption", "style_corruption", "geometry_perturbation", "group_flattening", "truncation")


@functools.lru_cache(10_000)
def _left(svg: str, got: str) -> tuple:
    """Of a corrupted drawing whether it differs and parses, its shapes and groups; few outcomes come up again and again."""
    valid = markup.is_svg(got)
    tags = [markup.local_name(e) for e in markup.TREES.shown(got).iter()] if valid else []
    return got != svg, valid, sum(t in corrupt.SHAPES for t in tags) if valid else -1, tags.count("g") if valid else -1


@query("SELECT p_partkey, fault, true AS changed, fault <> 'truncation' AS parses, CASE fault WHEN 'missing_objects' THEN 4 WHEN 'group_flattening' THEN 5 WHEN 'truncation' THEN -1 ELSE 5 END AS shapes, CASE WHEN fault = 'group_flattening' THEN 0 WHEN fault = 'truncation' THEN -1 ELSE 1 END AS groups "
    f"FROM part, (SELECT unnest({list(_TRIED)}) AS fault) ORDER BY ALL")  # fmt: skip
def fault_effects(spark, sf_dir):
    """What each fault leaves of a drawing with five shapes and a group, at the lowest level."""
    svg = f'{_HEAD}<g><rect x="3" width="150" height="90" fill="#123456"/><circle cx="40" cy="90" r="77" stroke="#123123"/></g><text x="5" y="9">label</text><path d="M 100 200 L 300 250"/><polygon points="1,1 9,9"/></svg>'

    @F.pandas_udf("changed boolean, parses boolean, shapes int, groups int")
    def run(fault, seed):
        return pd.DataFrame([_left(svg, _changed(f, svg, int(k))) for f, k in zip(fault, seed)], columns=["changed", "parses", "shapes", "groups"])

    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(t) for t in _TRIED])).alias("fault"))
    return spread(rows, "p_partkey").select("p_partkey", "fault", run("fault", "p_partkey").alias("x")).select("p_partkey", "fault", "x.*")


_SIZE = 1000


@query(f"""WITH c AS (SELECT o_orderkey // {_SIZE} * {_SIZE} AS chunk, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)), l AS (SELECT unnest(['medium', 'hard']) AS level),
n AS (SELECT level, chunk, count(*) AS rows, sum((42 + o_orderkey) * 1000)::BIGINT AS seeds FROM c, l GROUP BY ALL)
SELECT level AS part, chunk, rows, seeds FROM n UNION ALL SELECT 'truncation/' || level, chunk, greatest(1, round_even(rows * 0.1, 0))::BIGINT, NULL FROM n""")
def repair_checkpoints(spark, sf_dir):
    """Repair rows by chunk and level with their truncated rows, from a run that is cut off and resumed; one fault that never fails, so that seeds are known."""
    root = new_folder(spark, "repair")
    d = carriers.drawings(spark, sf_dir, close=True).select(F.col("o_orderkey").alias("row_index"), F.concat(F.lit("o"), "o_orderkey").alias("filename"), "svg", "dataset")
    options = {"rows_a_chunk": _SIZE, "types": ["missing_objects"], "least_mse": 0, "least_share": 0, "chunks_a_job": 1000}
    rows = materialize(d.orderBy("row_index"), "drawings")  # a job over some chunks reads these only
    repair.build_checkpoints(rows.where("row_index < 5000"), root, levels=("medium",), fraction=0, **options)
    repair.build_checkpoints(rows, root, resume=True, **options)
    got = repair.read_checkpoints(spark, root).withColumn("chunk", F.regexp_extract("path", r"chunk_(\d+)", 1).try_cast("long"))
    return got.groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(~F.contains("part", F.lit("truncation")), F.col("corruption_seed"))).alias("seeds"))


@query("SELECT doc_id, split, doc_id % 3 = 0 AS is_truncated, CASE WHEN doc_id % 3 = 0 THEN 'hard' ELSE 'medium' END AS corruption_level FROM (SELECT doc_id, ['train', 'test', 'val'][p] AS split FROM documents "
    "JOIN (SELECT sha256(text) AS digest, min(CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END) AS p FROM documents WHERE doc_id % 5 = 0 GROUP BY 1) ON digest = sha256(text) WHERE doc_id % 5 = 0)")  # fmt: skip
def packaged_rows(spark, sf_dir):
    """Repair chunks below a folder named truncation, or not, with the split of their drawing: the folders above the root do not count."""
    root = new_folder(spark, "pack") + "/truncation/roots"
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", "text")
    place = F.when(F.col("doc_id") % 4 == 0, "val").when(F.col("doc_id") % 4 == 1, "test").otherwise("train")
    rows = schemas.conform(d.select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("svg"), F.lit("x").alias("corrupted_svg"), F.when(F.col("doc_id") % 3 == 0, "hard").otherwise("medium").alias("corruption_level")), schemas.REPAIR)
    sinks.save(rows.where("corruption_level = 'hard'"), f"{root}/truncation/hard/chunk_00000000")
    sinks.save(rows.where("corruption_level = 'medium'"), f"{root}/medium/chunk_00000000")
    packed = splits.package(splits.packaged(tables.repair_chunks(spark, root, f"{root}/nothing"), "path"), d.select(F.col("text").alias("svg"), place.alias("split")))
    return packed.select(F.col("filename").cast("long").alias("doc_id"), "split", "is_truncated", "corruption_level")


@query("SELECT 0::BIGINT AS packaged, 0::BIGINT AS missing, 0::BIGINT AS chunks, 0::BIGINT AS repair, 0.0::DOUBLE AS share")
def empty_inputs(spark, sf_dir):
    """What comes of nothing: no packaged rows, no missing targets, no chunks, a share of 0."""
    none = spark.createDataFrame([], schemas.REPAIR)
    source = table(spark, sf_dir, "documents").select(F.col("text").alias("svg"), F.lit("train").alias("split"))
    empty = spark.createDataFrame([], "svg string, dataset string, split string")
    counts = [splits.package(none, source).count(), splits.missing_targets(none, splits.split_lookup(source)).first().missing, tables.chunks(spark, new_folder(spark, "nothing")).count(), tables.repair_chunks(spark, new_folder(spark, "nothing")).count()]
    assert statistics.primitive_statistics(statistics.counted(empty)).count() == 0
    return spark.createDataFrame([tuple(counts)], "packaged long, missing long, chunks long, repair long").withColumn("share", native.ratio(F.lit(0), F.lit(0)))


@query("SELECT doc_id, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS place FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS split FROM documents)")
def shuffled_splits(spark, sf_dir):
    """The shuffle of each split after it was made."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("split"))
    return sampling.numbered_in(d, ("split",), native.order_hash(F.col("doc_id")), "doc_id").select("doc_id", "place")


@query("SELECT doc_id, 1::BIGINT AS in_whole, 0::BIGINT AS in_parts FROM documents WHERE doc_id % 10 = 9 UNION ALL SELECT doc_id, 1, 2 FROM documents WHERE doc_id % 10 = 0")
def partition_check(spark, sf_dir):
    """Ids that parts leave out or hold twice."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 10
    return sampling.unsound_parts(d, [d.where(k < 5), d.where(((k >= 5) & (k < 9)) | (k == 0))], "doc_id")


# --- evaluation -------------------------------------------------------------------------------------

_SIMPLE = '<svg width="8" height="8"><rect width="4" height="4" fill="red"/></svg>'


@query("""SELECT o_orderkey, o_orderkey % 4 < 3 AS has_svg, o_orderkey % 4 < 2 AS valid, o_orderkey % 4 < 1 AS rendered, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 END AS mse, o_orderkey % 5 <> 0 AS target_rendered FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_orderkey % 4 < 3, o_orderkey % 4 < 2, o_orderkey % 4 < 1, NULL, false FROM orders WHERE o_orderkey % 5 = 0""")
def evaluated_predictions(spark, sf_dir):
    """How far each kind of answer comes: no drawing, one that does not parse, one that cannot be drawn, and the target itself."""
    k = F.col("o_orderkey")
    answer = F.when(k % 4 == 0, f"Here: {_SIMPLE}.").when(k % 4 == 1, "<svg><image/></svg>").when(k % 4 == 2, "<svg><rect></svg>").otherwise("none")
    rows = table(spark, sf_dir, "orders").select(k.alias("output_index"), F.when(k % 5 == 0, "<svg").otherwise(_SIMPLE).alias("svg"), answer.alias("text"))
    got = predictions.evaluated(rows, raster.NumpyRenderer())
    return got.select(F.col("output_index").alias("o_orderkey"), F.col("prediction_has_svg").alias("has_svg"), F.col("prediction_is_valid_svg").alias("valid"), F.col("prediction_rendered").alias("rendered"), F.col("pixel_mse").alias("mse"), "target_rendered")


@query("""WITH e AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS output_index FROM benchmark)
SELECT output_index, item_id AS evaluation_index, 'local' AS model, item_id / 1000 AS pixel_mse FROM e UNION ALL SELECT output_index, item_id, 'far', output_index / 500 FROM e""")
def aligned_models(spark, sf_dir):
    """Scores of models whose results are filed under different numbers."""
    items = sampling.numbered(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evaluation_index"), F.lit("f").alias("filename")), "evaluation_index", name="output_index")
    local = items.select("evaluation_index", (F.col("evaluation_index") / 1000).alias("pixel_mse"))
    far = items.select("output_index", (F.col("output_index") / 500).alias("pixel_mse"))
    return evaluation.aligned(items, {"local": local}, {"far": far}).select("output_index", "evaluation_index", "model", "pixel_mse")


@query("SELECT item_id AS output_index, item_id % 3 = 0 AS failed, item_id % 3 <> 0 AS answered FROM benchmark WHERE item_id % 4 <> 0")
def resumed_calls(spark, sf_dir):
    """Calls for examples without a stored result; a failed call is a row."""

    class Sometimes:
        async def generate(self, prompt: str) -> str:
            if int(prompt) % 3 == 0:
                raise TimeoutError("late")
            return prompt

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("output_index"), F.col("item_id").cast("string").alias("prompt"))
    got = predictions.generated(predictions.to_call(rows, rows.where("output_index % 4 = 0")), Sometimes())
    return got.select("output_index", F.col("request_error").isNotNull().alias("failed"), F.col("text").isNotNull().alias("answered"))


# --- training tasks ---------------------------------------------------------------------------------


def _lengths(text):
    """A tokenizer for queries: the lengths of the words between single spaces."""
    return F.transform(F.split(text, " "), lambda w: F.length(w))


def _tasks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    split = F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 5 == 1, "test").otherwise("train")
    return d.select("doc_id", F.col("source").alias("dataset"), split.alias("split"), F.substring("text", 1, 200).alias("text"), F.concat(F.lit("<svg>"), F.substring("text", 1, 60), F.lit("</svg>")).alias("svg"), F.substring("text", 1, 90).alias("corrupted_svg"))


_TASK_ROWS = "(SELECT doc_id, source AS dataset, CASE doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, substr(text, 1, 200) AS text, '<svg>' || substr(text, 1, 60) || '</svg>' AS svg, substr(text, 1, 90) AS corrupted_svg FROM documents WHERE text IS NOT NULL)"
_SYSTEM = config.SYSTEM_MESSAGE.replace("'", "''")


def _chat(user: str) -> str:
    return f"('<|im_start|>system' || chr(10) || '{_SYSTEM}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {user} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10))"


_CHAT = {
    "text2svg": _chat("text"),
    "image2svg": _chat(f"'{config.GENERATE_REQUEST}' || chr(10) || '<image>'"),
    "repair": _chat(f"'{config.REPAIR_REQUEST.strip()}' || chr(10) || chr(10) || corrupted_svg || chr(10) || '<image>'"),
}
_TARGET = "(svg || '<|im_end|>' || chr(10))"
_MOST = 62


def _long(name: str) -> str:
    return f"(len(string_split({_CHAT[name]}, ' ')) + len(string_split({_TARGET}, ' ')))"


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS task, {c} AS prompt FROM {_TASK_ROWS}" for n, c in _CHAT.items()))
def serialized_prompts(spark, sf_dir):
    """The prompts of the three tasks through the chat template."""
    d, out = _tasks(spark, sf_dir), None
    for name, task in tasks.TASKS.items():
        part = d.select("doc_id", F.lit(name).alias("task"), tasks.serialized(task).alias("prompt"))
        out = part if out is None else out.union(part)
    return out


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS task, {_long(n)} AS sequence_length FROM {_TASK_ROWS}" for n in _CHAT))
def task_lengths(spark, sf_dir):
    d, out = _tasks(spark, sf_dir), None
    for name, task in tasks.TASKS.items():
        part = tasks.with_length(d, task, _lengths).select("doc_id", F.lit(name).alias("task"), F.col("sequence_length").cast("long").alias("sequence_length"))
        out = part if out is None else out.union(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS task, split, count(*) FILTER ({_long(n)} <= {_MOST}) AS kept, count(*) FILTER ({_long(n)} > {_MOST}) AS removed FROM {_TASK_ROWS} GROUP BY split" for n in _CHAT))
def task_counts(spark, sf_dir):
    d, out = _tasks(spark, sf_dir), None
    for name, task in tasks.TASKS.items():
        part = tasks.length_counts(d, task, _lengths, most=_MOST).select(F.lit(name).alias("task"), "split", "kept", "removed")
        out = part if out is None else out.union(part)
    return out


@query(f"SELECT doc_id, split, svg, corrupted_svg FROM {_TASK_ROWS} WHERE {_long('repair')} <= {_MOST}")
def prepared_task(spark, sf_dir):
    """The rows of the repair task that are short enough, with its columns only."""
    return tasks.prepared(_tasks(spark, sf_dir), tasks.TASKS["repair"], _lengths, most=_MOST, keep=("doc_id",))


@query(f"""WITH t AS (SELECT doc_id, [length(w) FOR w IN string_split({_CHAT['text2svg']}, ' ')] AS p, [length(w) FOR w IN string_split({_TARGET}, ' ')] AS t FROM {_TASK_ROWS}),
b AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 6 AS batch_id FROM t), m AS (SELECT *, max(len(p) + len(t)) OVER (PARTITION BY batch_id) - len(p) - len(t) AS fill FROM b)
SELECT doc_id, batch_id, list_concat(p, t, [0 FOR x IN range(fill)])::INT[] AS input_ids, list_concat([-100 FOR x IN p], t, [-100 FOR x IN range(fill)])::INT[] AS labels, list_concat([1 FOR x IN p], [1 FOR x IN t], [0 FOR x IN range(fill)])::INT[] AS attention_mask FROM m""")
def collated_task(spark, sf_dir):
    """Batches of the text task: prompt and target in a row, the prompt without labels, filled up at the end."""
    rows = tasks.loader(_tasks(spark, sf_dir), "doc_id", 6)
    return tasks.collated(rows, tasks.TASKS["text2svg"], _lengths).select("doc_id", "batch_id", "input_ids", "labels", "attention_mask")


@query(f"""WITH h AS (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY sha256('42:' || doc_id), doc_id) - 1) % 2 AS half FROM {_TASK_ROWS} WHERE split = 'train'),
i AS (SELECT 'text2svg' AS task, * EXCLUDE (half) FROM h WHERE half = 0 UNION ALL SELECT 'image2svg', * EXCLUDE (half) FROM h WHERE half = 1 UNION ALL SELECT 'repair', * FROM {_TASK_ROWS} WHERE split = 'train'
    UNION ALL SELECT t, r.* FROM {_TASK_ROWS} r, (SELECT unnest(['text2svg', 'image2svg', 'repair']) AS t) WHERE split = 'val'),
k AS (SELECT * FROM i WHERE CASE task WHEN 'text2svg' THEN {_long('text2svg')} WHEN 'image2svg' THEN {_long('image2svg')} ELSE {_long('repair')} END <= {_MOST})
SELECT task, split, doc_id, (row_number() OVER (PARTITION BY task, split ORDER BY CASE WHEN split = 'train' THEN sha256('42:3:' || doc_id) ELSE '' END, doc_id) - 1) // 4 AS batch_id FROM k""")
def training_graph(spark, sf_dir):
    """Batches of the three tasks for training (the shuffle of epoch 3) and validation."""
    d, out = _tasks(spark, sf_dir), None
    graph = tasks.training_graph(d, d, "doc_id", _lengths, 4, epoch=3, most=_MOST)
    for (name, split), rows in graph.items():
        part = rows.select(F.lit(name).alias("task"), F.lit(split).alias("split"), "doc_id", "batch_id")
        out = part if out is None else out.union(part)
    return out


@query("""WITH d AS (SELECT conv_id, turn, conv_id * 1000 + turn AS key, role FROM conversations WHERE role IN ('user', 'assistant')), n AS (SELECT role, count(*) AS n FROM d GROUP BY role),
e AS (SELECT d.*, n, unnest(range(1, (ceil(700 / n) + 1)::BIGINT)) AS epoch FROM d JOIN n USING (role)),
r AS (SELECT *, (epoch - 1) * n + row_number() OVER (PARTITION BY role, epoch ORDER BY sha256('42:' || epoch || ':' || key), key) - 1 AS step FROM e)
SELECT role, key, epoch::INT AS epoch, step FROM r WHERE step < 700""")
def shuffled_epochs(spark, sf_dir):
    """Endless epochs of two tasks, each with a shuffle of its own."""
    d = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return batches.repeated(d, 700, "key", by=("role",), seed=config.SEED).select("role", "key", "epoch", "step")


@query(f"SELECT doc_id, split FROM {_TASK_ROWS} WHERE split = 'val' UNION ALL SELECT min(doc_id), s FROM {_TASK_ROWS}, (SELECT unnest(['train', 'test']) AS s) WHERE split = 'val' GROUP BY s")
def validation_rows(spark, sf_dir):
    return tasks.validation_only(_tasks(spark, sf_dir), "doc_id").select("doc_id", "split")

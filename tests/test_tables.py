import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from svgloom import cli, config, schemas
from svgloom.functions import native
from svgloom.operators import batches, captions, evaluation, sampling, splits
from svgloom.plans import catalog
from svgloom.sources import sinks, tables
from svgloom.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 8) if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(repr(plain(tuple(r))) for r in df.collect())
    want = sorted(repr(plain(r)) for r in duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == want and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_training_arrays_and_padding(spark):
    d = spark.createDataFrame([(0, [1, 2, 0], [1, 1, 0], [7, 8], 0), (1, [3, 4, 5], [1, 1, 1], [7, 8], 0)], "k int, prompt_ids array<int>, mask array<int>, target_ids array<int>, batch_id int")
    out = batches.padded(batches.training_arrays(d, mask="mask"), {"input_ids": 0, "labels": -100, "attention_mask": 0}).orderBy("k").collect()
    assert [r.input_ids for r in out] == [[1, 2, 7, 8, 0], [3, 4, 5, 7, 8]]
    assert [r.labels for r in out] == [[-100, -100, 7, 8, -100], [-100, -100, -100, 7, 8]]
    assert [r.attention_mask for r in out] == [[1, 1, 1, 1, 0], [1, 1, 1, 1, 1]]
    long = spark.createDataFrame([([1] * 12_288, [1])], "prompt_ids array<int>, target_ids array<int>")
    with pytest.raises(Exception, match="sequence too long"):
        batches.training_arrays(long).collect()


def test_fitting_and_halves(spark):
    d = spark.createDataFrame([(100, "a", "b", 1), (13_000, "c", "d", 2), (12_288, "e", "f", 3)], "measured_length long, text string, svg string, unused long")
    out = batches.fitting(d, "measured_length", ["text", "svg"])
    assert out.columns == ["text", "svg"] and out.count() == 2
    h = sampling.halves(spark.createDataFrame([(k, "shapes" if k < 4 else "diagrams") for k in range(8)], "row_id long, dataset string"), "row_id", "dataset", seed=7)
    assert {(r.dataset, r.half): r["count"] for r in h.groupBy("dataset", "half").count().collect()} == {(d, k): 2 for d in ("shapes", "diagrams") for k in (0, 1)}
    with pytest.raises(ValueError):
        sampling.halves(h, "row_id", "nothing")


def test_epochs_are_read_again(spark):
    d = spark.createDataFrame([("first", 0), ("second", 1)], "name string, k int")
    assert [(r.epoch, r["name"]) for r in batches.repeated(d, 5, "k").orderBy("step").collect()] == [(1, "first"), (1, "second"), (2, "first"), (2, "second"), (3, "first")]


def test_split_priority_and_propagation(spark):
    source = spark.createDataFrame([("a", "test"), ("a", "train"), ("b", "val")], "svg string, split string")
    assert {r.split for r in splits.split_lookup(source).collect()} == {"train", "val"}
    repair = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "svg string, corrupted_svg string")
    assert {(r.corrupted_svg, r.split) for r in splits.package(repair, source).collect()} == {("x", "train"), ("y", "train"), ("z", "val")}
    with pytest.raises(ValueError, match="1 repair targets"):
        splits.package(repair.union(spark.createDataFrame([("c", "q")], "svg string, corrupted_svg string")), source)
    assert splits.package(repair.limit(0), source).count() == 0


def test_summaries(spark):
    d = spark.createDataFrame([(1, "f", True, True, True, 0.1), (2, "g", False, False, False, None)], schemas.RESULTS)
    r = evaluation.summarized(d).first()
    assert (r.svg_rate, r.valid_rate, r.render_rate, r.mse_count, round(r.mean_pixel_mse, 6)) == (0.5, 0.5, 0.5, 1, 0.1)
    none = evaluation.summarized(d.limit(0)).first()
    assert (none.svg_rate, none.mean_pixel_mse) == (0.0, None)
    losses = spark.createDataFrame([("text", 1.0, 0), ("text", 3.0, 1), ("image", 2.0, 0), ("image", 4.0, 1), ("repair", 3.0, 0), ("repair", 5.0, 1), ("repair", 99.0, 2)], "task string, loss double, batch int")
    assert {r.task: r.loss for r in evaluation.macro_validation(losses, 2).collect()} == {"text": 2.0, "image": 3.0, "repair": 4.0, "all": 3.0}


def test_ties_go_to_the_first_model(spark):
    s = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "b", 0.1), (2, "a", 0.2)], "evaluation_index long, model string, pixel_mse double")
    assert {r.evaluation_index: r.winner for r in evaluation.winners(s, ["a", "b"]).collect()} == {1: "a", 2: "b"}


def test_truncation_count_rounds_half_to_even(spark):
    d = spark.range(25).select(F.col("id"), F.lit("c").alias("chunk")).union(spark.createDataFrame([(99, "d")], "id long, chunk string"))
    got = {r.chunk: r["count"] for r in sampling.fraction_picks(d, "id", "chunk", 0.1).groupBy("chunk").count().collect()}
    assert got == {"c": 2, "d": 1} and sampling.fraction_picks(d, "id", "chunk", 0).count() == 0


def test_checkpoints(spark):
    d = spark.createDataFrame([("r", "checkpoint-1000"), ("r", "checkpoint-2000"), ("r", "final")], "run string, path string")
    assert [r.path for r in sampling.retained(d).orderBy("place").collect()] == ["checkpoint-2000", "checkpoint-1000"]
    assert tuple(sampling.latest(d).first()) == ("checkpoint-2000", 2000) and tuple(sampling.latest(d.limit(0)).first()) == (None, 0)


def test_chunks_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    assert tables.chunks(spark, root).count() == 0
    row = spark.createDataFrame([(0, "f", "<svg/>", "t", None, None, True, None)], schemas.CHECKPOINT)
    sinks.save_chunk(row, root, 0)
    sinks.save_chunk(row.drop("caption_style"), root, 1)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_chunk(row, root, 1)
    got = tables.chunks(spark, root, "key").collect()
    assert sorted((r.chunk, r.caption_style, r.dataset) for r in got) == [(0, "concise", "key"), (1, "concise", "key")]
    sinks.replace(row, f"{root}_t")
    sinks.replace(row.limit(0), f"{root}_t")
    assert spark.read.parquet(f"{root}_t").count() == 0
    sinks.save_splits(row.withColumn("split", F.lit("val")), f"{root}_s")
    assert tables.dataset(spark, f"{root}_s").first().split == "val"
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, root + "x", root + "y")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"tasks": {"text": [{"evaluation_index": 1, "filename": "a"}], "image": [{"evaluation_index": 3, "filename": "b"}, {"evaluation_index": 8, "filename": "c"}]}}))
    got = evaluation.manifest_examples(tables.manifest(spark, f"file://{tmp_path}/m.json")).collect()
    assert [(r.output_index, r.evaluation_index) for r in got] == [(0, 3), (1, 8)]


def test_only_new_files_are_read(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).withColumn("keep", F.col("id") % 2 == 0).write.mode("append").parquet(src)
        incremental.run_new_files(spark, src, "id long, keep boolean", lambda d: d.where("keep"), out, check)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(0, 30, 2))
    n = incremental.run_until_target(spark, src, "id long, keep boolean", lambda d: d, f"{out}2", f"{check}2", 6)
    assert 6 <= n <= 10


def test_command_lines(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    rows = spark.createDataFrame([(f"{k}.svg", f'<svg width="9" height="9"><rect x="{k}" width="4" height="5" fill="red"/><line x2="9" y2="{k}" stroke="blue"/></svg>', "vfig", "train", "t") for k in range(8)], "filename string, svg string, dataset string, split string, text string")
    rows.write.partitionBy("split").parquet(src)
    cli.main(["statistics", src, f"file://{tmp_path}/stats"], spark)
    assert "| vfig | all | 8 | 0 | 50.0%" in (tmp_path / "stats" / "svg_stats.md").read_text()
    cli.main(["repair", src, f"file://{tmp_path}/rep/medium/chunk_00000000", "--levels", "medium"], spark)
    cli.main(["package", src, f"file://{tmp_path}/pack", "--roots", f"file://{tmp_path}/rep"], spark)
    packed = tables.dataset(spark, f"file://{tmp_path}/pack")
    assert packed.count() > 0 and {r.split for r in packed.collect()} == {"train"}
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25)], "evaluation_index long, model string, pixel_mse double")
    s.write.parquet(f"file://{tmp_path}/scores")
    cli.main(["compare", f"file://{tmp_path}/scores", f"file://{tmp_path}/cmp", "--models", "a,b"], spark)
    assert "| b | 0.2500 | 0.2500 | 1/1 |" in (tmp_path / "cmp" / "RESULTS.md").read_text()


def test_sources_and_samples(spark):
    with pytest.raises(ValueError):
        config.source("nothing")
    with pytest.raises(ValueError):
        config.split_size(config.source("vfig_shapes"), "val")
    d = spark.range(50).withColumn("split", F.lit("train"))
    assert tables.sampled(d, config.source("vfig_shapes"), "id", 7).count() == 7
    assert tables.sampled(d, config.source("vfig_shapes"), "id").count() == 50
    with pytest.raises(ValueError, match="has no split test"):
        tables.sampled(d, config.source("starvector_emoji"), "id")
    n = sampling.numbered(d.repartition(7), "id", start=3).collect()
    assert sorted((r.id, r.row_index) for r in n) == [(k, k + 3) for k in range(50)]
    assert [r.id for r in sampling.row_range(spark.range(10).withColumn("row_index", F.col("id")), 8, 20, 5).collect()] == [8, 9] and sampling.row_range(d.withColumn("row_index", F.col("id")), 9, 3).count() == 0


def test_generated_outputs(spark):
    d = spark.createDataFrame([("x <svg><rect/></svg> y", None), ("<svg><rect></svg>", None), ("none", "timeout")], "text string, request_error string")
    assert [(r.prediction_has_svg, r.prediction_is_valid_svg, r.request_error) for r in sinks.generated(d).collect()] == [(True, True, None), (True, False, None), (False, False, "timeout")]


def test_resume(spark):
    rows = spark.range(10).select(F.col("id").alias("row_index"), (F.col("id") % 2 == 0).alias("keep"))
    assert captions.not_done(rows, rows.where("row_index < 4")).count() == 6
    assert [r.row_index for r in captions.until_target(rows, 2).orderBy("row_index").collect()] == [0, 1, 2]
    assert native.retryable(F.lit(429)) is not None

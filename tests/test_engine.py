import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svgloom import cli, config, schemas
from svgloom.errors import CorruptionError
from svgloom.functions import corrupt, native, raster
from svgloom.operators import batches, captions, evaluation, repair, sampling, tasks
from svgloom.sources import sinks, tables
from svgloom.streaming import incremental


def test_decimals_as_python_writes_them(spark):
    rng = random.Random(2)
    values = [1 / 8, 3 / 8, 5 / 8, 7 / 8, 0.285, 0.005, 0.015, 1.005, 2.5, 0.0, -0.125, -0.001, 123456.785, 0.9999] + [rng.uniform(-3, 3) for _ in range(300)] + [rng.randint(0, 400) / 200 for _ in range(200)]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    got = d.select("x", *[native.fixed(F.col("x"), n).alias(f"f{n}") for n in (1, 2, 6)], native.percent(F.col("x")).alias("p")).collect()
    for r in got:
        assert (r.f1, r.f2, r.f6, r.p) == (f"{r.x:.1f}", f"{r.x:.2f}", f"{r.x:.6f}", f"{r.x * 100:.1f}%")


def test_numbers_in_groups_do_not_depend_on_partitions(spark):
    d = spark.range(1000).select((F.col("id") % 7 == 0).alias("g"), (F.col("id") * 37 % 1000).alias("o"))
    for parts in (1, 9):
        got = sampling.numbered_in(d.repartition(parts), ("g",), "o").collect()
        for g in (True, False):
            assert [r.place for r in sorted((r for r in got if r.g == g), key=lambda r: r.o)] == list(range(sum(r.g == g for r in got)))
    assert sorted(r.place for r in sampling.numbered_in(d, (), "o").collect()) == list(range(1000))
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o int")
    assert sorted((r.g or "", r.place) for r in sampling.numbered_in(nulls, ("g",), "o").collect()) == [("", 0), ("", 1), ("a", 0)]


def test_what_did_not_render_cannot_win(spark):
    s = spark.createDataFrame([(1, "a", None), (1, "b", 0.5), (2, "a", None), (3, "a", 0.1), (3, "b", 0.2)], "evaluation_index long, model string, pixel_mse double")
    assert {r.evaluation_index: r.winner for r in evaluation.winners(s, ["a", "b"]).collect()} == {1: "b", 3: "a"}
    assert {r.model: (r.wins, r.median_mse) for r in evaluation.model_summary(s, ["a", "b"]).collect()} == {"a": (1, 0.1), "b": (1, 0.35)}


def test_a_model_without_a_result_is_an_error(spark):
    e = spark.createDataFrame([(0, 5, "f"), (1, 9, "g")], "output_index long, evaluation_index long, filename string")
    by_e, by_o = spark.createDataFrame([(5, 0.1), (9, None)], "evaluation_index long, pixel_mse double"), spark.createDataFrame([(0, 0.3), (1, 0.4)], "output_index long, pixel_mse double")
    assert {(r.output_index, r.model): r.pixel_mse for r in evaluation.aligned(e, {"base": by_e}, {"far": by_o}).collect()} == {(0, "base"): 0.1, (1, "base"): None, (0, "far"): 0.3, (1, "far"): 0.4}
    with pytest.raises(Exception, match="no result of far for example 1"):
        evaluation.aligned(e, {"base": by_e}, {"far": by_o.where("output_index = 0")}).collect()


def test_files_after_the_target_are_left_for_a_later_run(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for part in range(5):
        spark.range(part * 10, part * 10 + 10, numPartitions=1).withColumn("keep", F.lit(True)).write.mode("append").parquet(src)
    schema = "id long, keep boolean"
    assert incremental.run_until_target(spark, src, schema, lambda d: d, out, check, 15) == 20
    assert incremental.run_until_target(spark, src, schema, lambda d: d, out, check, 15) == 20
    assert incremental.run_until_target(spark, src, schema, lambda d: d, out, check, 45) == 50
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(50))


def test_replacement_survives_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two moves
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_folders_above_the_root_do_not_count(spark, tmp_path):
    root = f"file://{tmp_path}/truncation/a b/roots"
    row = spark.createDataFrame([("f", "s", "c", "t", 1, 2, "hard", 0.1, 0.2, "", "", "")], schemas.REPAIR)
    sinks.save(row, f"{root}/hard/chunk_00000000")
    sinks.save(row, f"{root}/truncation/hard/chunk_00000000")
    assert sorted(r.path.split("chunk")[0] for r in tables.repair_chunks(spark, root).collect()) == ["hard/", "truncation/hard/"]


def _drawings(spark, n):
    return spark.createDataFrame([(k, f"{k}.svg", f'<svg xmlns="http://www.w3.org/2000/svg" width="20" height="20"><rect x="1" width="{k % 9 + 5}" height="9" fill="red"/><circle cx="9" cy="9" r="5"/><line x2="9" y2="{k}" stroke="blue"/></svg>') for k in range(n)], "row_index long, filename string, svg string")


def _rows(spark, root):
    return sorted(map(tuple, repair.read_checkpoints(spark, root).withColumn("path", F.regexp_extract("path", "(chunk_[0-9]+)", 1)).collect()))


def test_checkpoints_by_chunk_and_level(spark, tmp_path):
    root, rows = f"file://{tmp_path}/c", _drawings(spark, 25)
    options = {"rows_a_chunk": 10, "least_mse": 0, "least_share": 0}
    assert repair.build_checkpoints(rows, root, **options) == 6
    first = _rows(spark, root)
    with pytest.raises(ValueError, match="exist"):
        repair.build_checkpoints(rows, root, **options)
    tables.drop(spark, f"{root}/truncation/hard/chunk_00000010")  # only this is made again
    assert repair.build_checkpoints(rows, root, resume=True, **options) == 0
    assert _rows(spark, root) == first
    tables.drop(spark, f"{root}/medium/chunk_00000020")
    tables.drop(spark, f"{root}/truncation/medium/chunk_00000020")
    assert repair.build_checkpoints(rows, root, resume=True, **options) == 1
    assert _rows(spark, root) == first
    parts = [r.part for r in repair.read_checkpoints(spark, root).collect()]
    assert parts == sorted(parts, key=["medium", "hard", "truncation/medium", "truncation/hard"].index)
    assert repair.read_checkpoints(spark, f"file://{tmp_path}/none").count() == 0
    none = f"file://{tmp_path}/d"
    repair.build_checkpoints(rows, none, fraction=0, **options)
    assert {r.part for r in repair.read_checkpoints(spark, none).collect()} == {"medium", "hard"}


def test_truncation_seeds_are_those_of_the_chunk(spark):
    rows = repair.repair_rows(_drawings(spark, 30), ("hard",), types=["missing_objects"], least_mse=0, least_share=0, keep=("row_index",))
    got = repair.truncated_rows(rows, "row_index", 10, 0.3).collect()
    assert {r.corruption_seed for r in got} == {(42 + c) * 100_000 + k for c in (0, 10, 20) for k in random.Random(42 + c).sample(range(10), 3)}
    assert all(r.render_mse == -1 and r.corruption_type.endswith("+truncation") for r in got)


def test_captions_stop_at_the_target(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def caption(self, image, prompt):
            seen.add(1)
            return "c"

    raw = _drawings(spark, 40)
    got = captions.captioned_until(raw, config.source("vfig_shapes"), "train", 12, rows_a_step=10, captioner=Counting(), renderer=raster.NumpyRenderer())
    assert got.where("keep").count() == 12 and seen.value == 20


def test_text_and_styles_are_drawn():
    r = raster.NumpyRenderer()
    red = r.render('<svg width="4" height="4"><rect width="4" height="4" style="fill: red; stroke:none"/></svg>')
    assert (red == np.array([255, 0, 0, 255])).all()
    plain, told = r.render('<svg width="40" height="20"/>'), r.render('<svg width="40" height="20"><text x="2" y="15" font-size="10">ab <tspan>c</tspan></text></svg>')
    assert raster.difference(plain, told)[1] > 0.05
    svg = '<svg xmlns="http://www.w3.org/2000/svg" width="60" height="30"><text x="5" y="20">label</text></svg>'
    assert repair.attempt(svg, 1, 0, ["text_corruption"], "easy", repair.Acceptance(svg, r, 0.002, 0.01)) is not None


def test_windows_give_what_whole_pictures_give(monkeypatch):
    svg = '<svg width="40" height="30"><rect x="-5" y="3" width="20" height="90" fill="#123456" stroke="red" stroke-width="3"/><circle cx="38" cy="4" r="9" opacity="0.5"/><path d="M 1 1 L 30 20 L 3 9 Z M 5 5 h 9 v 9 z" fill="blue"/><line x1="-9" x2="99" y2="30" stroke="green"/></svg>'
    small = raster.NumpyRenderer().render(svg)
    monkeypatch.setattr(raster.NumpyRenderer, "_window", lambda self, points, margin=0.0: (slice(None), slice(None)))
    assert (raster.NumpyRenderer().render(svg) == small).all()


def test_rectangles_are_the_polygons_of_their_corners():
    rng = random.Random(3)
    for _ in range(60):
        x, y, w, h = (rng.choice([rng.uniform(-9, 30), rng.randint(-5, 30) + 0.5, rng.randint(0, 30)]) for _ in range(4))
        w, h = abs(w), abs(h)
        for style in ('fill="red"', 'fill="blue" opacity="0.4"', 'fill="none" stroke="red"'):
            a = f'<svg width="24" height="20"><rect x="{x}" y="{y}" width="{w}" height="{h}" {style}/></svg>'
            b = f'<svg width="24" height="20"><polygon points="{x},{y} {x + w},{y} {x + w},{y + h} {x},{y + h}" {style}/></svg>'
            if w > 0 and h > 0:
                assert (raster.NumpyRenderer().render(a) == raster.NumpyRenderer().render(b)).all(), a


def test_resampling():
    flat = np.full((5, 7, 4), 200, np.uint8)
    assert (raster.resized(flat, 11, 3)[..., 3] == 200).all() and abs(raster.resized(flat, 11, 3).astype(int) - 200).max() <= 1
    ramp = np.zeros((1, 64, 4), np.uint8)
    ramp[..., 0], ramp[..., 3] = np.arange(64) * 4, 255
    assert abs(raster.resized(ramp, 1, 32)[0, 4:-4, 0].astype(int) - (np.arange(4, 28) * 8 + 2)).max() <= 1
    assert (raster.read_png(raster.png(ramp)) == ramp).all()
    assert raster.gallery([[ramp, None], [None, flat]], cell=20, gap=2).shape == (46, 46, 4)


def test_sampled_sources(spark):
    d = spark.range(20)
    assert tables.sample(spark, {"train": d}, config.source("vfig_shapes"), "id", 5).count() == 5
    assert tables.sample(spark, d, config.source("vfig_shapes"), "id", 5, streaming=False).count() == 5


def test_missing_target_files_are_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"tasks": {"image": [{"evaluation_index": 3, "filename": "b"}]}}))
    (tmp_path / "a" / "0003").mkdir(parents=True)
    (tmp_path / "a" / "0003" / "target.svg").write_text("x")
    with pytest.raises(Exception, match="missing for evaluation index 3"):
        tables.examples(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/a").collect()
    (tmp_path / "a" / "0003" / "target.png").write_text("x")
    assert tables.examples(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/a").first().output_index == 0


def test_tasks_need_their_splits(spark):
    d = spark.createDataFrame([(0, "a", "train", "t", "s", "c")], "k long, dataset string, split string, text string, svg string, corrupted_svg string")
    with pytest.raises(ValueError, match="Dataset is missing required splits: test, val"):
        tasks.training_graph(d, d, "k", lambda c: F.split(c, " ").cast("array<int>"), 2)
    assert tasks.validation_only(d, "k").count() == 0
    long = spark.createDataFrame([(1, [1] * 9, [2])], "k long, prompt_ids array<int>, target_ids array<int>")
    assert batches.training_arrays(long).first().input_ids == [1] * 9 + [2]


def test_command_lines(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    _drawings(spark, 6).select(F.lit("vfig").alias("dataset"), "filename", "svg", F.lit("train").alias("split")).write.parquet(src)
    cli.main(["repair-build", src, f"file://{tmp_path}/rep", "--rows-a-chunk", "4", "--datasets", "vfig", "--least-mse", "0", "--least-share", "0"], spark)
    assert spark.read.parquet(f"file://{tmp_path}/rep").groupBy("corruption_level").count().count() == 2
    rows = _drawings(spark, 4).select(F.col("row_index").alias("output_index"), "filename", "svg", F.lit("p").alias("prompt"))
    rows.write.parquet(f"file://{tmp_path}/ex")
    cli.main(["evaluate", f"file://{tmp_path}/ex", f"file://{tmp_path}/ev"], spark)
    assert (tmp_path / "ev" / "examples" / "0003" / "result.json").exists() and (tmp_path / "ev" / "summary.json").exists()
    for _ in range(2):
        cli.main(["external", f"file://{tmp_path}/ex", f"file://{tmp_path}/xt"], spark)
    assert spark.read.parquet(f"file://{tmp_path}/xt/results.parquet").count() == 4
    sinks.inspection(spark.read.parquet(f"file://{tmp_path}/rep"), f"file://{tmp_path}/look", 2, raster.NumpyRenderer())
    assert (tmp_path / "look" / "0001_corrupted.svg").exists() and any(p.suffix in (".png", ".txt") for p in (tmp_path / "look").iterdir())


def test_faults_say_why():
    with pytest.raises(CorruptionError):
        corrupt.shifted("abc", random.Random(1), "easy")

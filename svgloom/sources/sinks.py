"""Writers. A Spark write is visible when its job is committed, so none needs a temporary folder of its own but a replacement."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom.functions import native


def save(df: DataFrame, path: str) -> None:
    """A new table; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def save_splits(df: DataFrame, path: str) -> None:
    """One folder for each split, replacing what is there."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """A table in the place of an older one, which is moved aside, never deleted, before the new one has its name.

    A crash leaves the older table under its name or under ``path + ".old"``, from where the next call puts it back first.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    now, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".tmp", ".old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source, target) -> None:
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    if fs.exists(old) and not fs.exists(now):
        move(old, now)
    df.write.mode("overwrite").parquet(path + ".tmp")
    fs.delete(old, True)
    if fs.exists(now):
        move(now, old)
    move(new, now)
    fs.delete(old, True)


def save_chunk(df: DataFrame, root: str, number: int, digits: int = 6) -> str:
    path = f"{root}/chunk_{number:0{digits}d}"
    save(df, path)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver to whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def markdown(rows: list[dict], columns: list[str]) -> str:
    lines = [columns, ["---"] * len(columns), *[[str(r[c]) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_statistics(summary: DataFrame, folder: str) -> None:
    """svg_stats.json and svg_stats.md of a table that has a row for each source and split."""
    spark = summary.sparkSession
    rows = [r.asDict() for r in summary.orderBy("dataset", "split").collect()]
    write_text(spark, f"{folder}/svg_stats.json", json.dumps(rows, indent=2) + "\n")
    shares = {"basic%": "basic_pct", "connector%": "connector_pct", "simple%": "simple_pct", "complex%": "complex_pct"}
    shown = [r | {k: f"{r[v] * 100:.1f}%" for k, v in shares.items()} | {"avg_geom/row": f"{r['avg_geometric_per_row']:.1f}"} for r in rows]
    table = markdown(shown, ["dataset", "split", "rows", "parse_errors", *shares, "avg_geom/row"])
    write_text(spark, f"{folder}/svg_stats.md", f"# SVG Primitive Statistics\n\n{table}\n")


def write_results(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Results as JSON lines, and the summary (one row for each run) as JSON."""
    results.write.mode("overwrite").json(f"{folder}/results")
    write_text(results.sparkSession, f"{folder}/summary.json", json.dumps([r.asDict() for r in summary.collect()], indent=2))


def write_comparison(wide: DataFrame, summary: DataFrame, folder: str, wins: DataFrame | None = None) -> None:
    """results.csv, RESULTS.md and summary.json: the wide table, and models with mean, median and wins over the real number of examples."""
    wide.write.mode("overwrite").option("header", True).csv(f"{folder}/results.csv")
    spark, n = wide.sparkSession, wide.count()
    models = [r.asDict() for r in summary.orderBy("mean_mse", "model").collect()]
    shown = [{"Model": r["model"], "Mean MSE": f"{r['mean_mse']:.4f}", "Median MSE": f"{r['median_mse']:.4f}", "Best MSE": f"{r['wins']}/{n}"} for r in models]
    text = ["# Image-to-SVG model comparison", "", f"All models are compared on the {n} examples that every one of them rendered.", "", markdown(shown, ["Model", "Mean MSE", "Median MSE", "Best MSE"]), "", "The pixel error compares pictures, not meaning: a sparse drawing can have a low one by chance."]
    write_text(spark, f"{folder}/RESULTS.md", "\n".join(text) + "\n")
    pairs = {f"{a}_over_{b}": w for r in (wins.collect() if wins is not None else []) for a, b, w in ((r["first"], r["second"], r["first_wins"]), (r["second"], r["first"], r["second_wins"]))}
    write_text(spark, f"{folder}/summary.json", json.dumps({"num_examples": n, "models": {r.pop("model"): r for r in models}, "pairwise_wins": pairs}, indent=2))


def _folder(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs, path: str, content: bytes) -> None:
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(content)


_RESULT = ("prediction_has_svg", "prediction_is_valid_svg", "prediction_rendered", "prediction_error", "target_rendered", "target_error", "pixel_mse")


def save_examples(rows: DataFrame, folder: str) -> int:
    """A folder NNNN for each evaluated row (as predictions.evaluated gives it, with filename, svg and text): target.svg and .png, prediction.txt, .svg and .png, and
    result.json, the parts that exist. Written by the tasks; a task that runs again writes the same files. Returns the number of folders."""

    def write(part) -> None:
        fs, base = _folder(folder)
        for r in part:
            at = f"{base}/{r.output_index:04d}"
            result = {"index": r.output_index, "filename": r.filename} | {k: r[k] for k in _RESULT if r[k] is not None}
            files = {"target.svg": r.svg, "prediction.txt": r.text or "", "prediction.svg": r.prediction_svg, "prediction.png": r.prediction_png, "target.png": r.target_png, "result.json": json.dumps(result, indent=2)}
            for name, content in files.items():
                if content is not None:
                    _put(fs, f"{at}/{name}", content.encode("utf-8") if isinstance(content, str) else bytes(content))

    rows.foreachPartition(write)
    return rows.count()


def save_gallery(rows: DataFrame, pictures: list[str], path: str, most: int = 100) -> None:
    """One PNG with a row for each of the first ``most`` examples (by output_index) and a cell for each picture column (PNG bytes or null): a look at few rows, made by the driver."""
    from svgloom.functions import raster

    got = rows.select("output_index", *pictures).orderBy("output_index").limit(most).collect()
    cells = [[raster.read_png(bytes(r[c])) if r[c] is not None else None for c in pictures] for r in got]
    fs, place = _folder(path)
    _put(fs, place, raster.png(raster.gallery(cells)))


def inspection(repair: DataFrame, folder: str, n: int = 20, renderer=None) -> None:
    """The first pairs, clean and corrupted, as files to look at: markup and picture, or why there is no picture."""
    from svgloom.errors import RowError
    from svgloom.functions import raster

    draw = renderer or raster.default_renderer()
    fs, base = _folder(folder)
    for k, r in enumerate(repair.orderBy("filename", "corruption_seed").limit(n).collect()):
        for kind, svg in (("clean", r.svg), ("corrupted", r.corrupted_svg)):
            _put(fs, f"{base}/{k:04d}_{kind}.svg", svg.encode("utf-8"))
            try:
                _put(fs, f"{base}/{k:04d}_{kind}.png", raster.png(draw.render(svg)))
            except RowError as e:
                _put(fs, f"{base}/{k:04d}_{kind}.render_error.txt", str(e).encode("utf-8"))


def generated(outputs: DataFrame) -> DataFrame:
    """Generated texts with what evaluation asks of them: whether they hold a drawing and whether it is valid; errors of the request stay."""
    from svgloom.functions import markup

    svg = native.extracted_svg(F.col("text"))
    return outputs.withColumn("svg", svg).withColumn("prediction_has_svg", F.col("svg").isNotNull()).withColumn("prediction_is_valid_svg", markup.valid(F.col("svg")))

"""Command lines: python -m svgloom.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.operators import captions, evaluation, predictions, repair, sampling, splits, statistics
from svgloom.session import materialize, ship
from svgloom.sources import sinks, tables


def statistics_command(spark, a):
    counted = statistics.counted(tables.dataset(spark, a.source).select("dataset", "split", "svg"))
    sinks.write_statistics(statistics.primitive_statistics(counted), a.output)


def sample_command(spark, a):
    spec = config.source(a.dataset)
    sinks.save_splits(tables.sampled(tables.dataset(spark, a.source), spec, a.key, a.size, a.seed), a.output)


def captions_command(spark, a):
    spec = config.source(a.dataset)
    raw = tables.dataset(spark, a.source).where(F.col("split") == a.split)
    target = config.split_size(spec, a.split).target
    sinks.save(captions.final_rows(captions.captioned_until(sampling.numbered(raw, a.key), spec, a.split, target), target), a.output)


def dataset_command(spark, a):
    """All splits of a source that are stored: a folder of the final table for each."""
    spec, stored = config.source(a.dataset), tables.dataset(spark, a.source)
    present = {r.split for r in stored.select("split").distinct().collect()}
    for name, size in spec.splits.items():
        if name in present:
            raw = sampling.numbered(stored.where(F.col("split") == name), a.key)
            sinks.save(captions.final_rows(captions.captioned_until(raw, spec, name, size.target), size.target), f"{a.output}/{name}")


def repair_command(spark, a):
    rows = sampling.numbered(tables.dataset(spark, a.source), a.key)
    chosen = sampling.row_range(rows, a.start, a.end, a.size)
    sinks.replace(repair.repair_rows(chosen, tuple(a.levels.split(",")), per_row=a.per_row, seed=a.seed, least_mse=a.least_mse, least_share=a.least_share), a.output)


def package_command(spark, a):
    rows = splits.packaged(tables.repair_chunks(spark, *a.roots.split(",")), "path")
    sinks.save_splits(splits.package(rows, tables.dataset(spark, a.source)), a.output)


def repair_build_command(spark, a):
    """Repair checkpoints of each split by chunk and level, their truncated rows, and the combined table with a folder for each split."""
    stored = tables.of_sources(tables.dataset(spark, a.source), a.datasets.split(",")) if a.datasets else tables.dataset(spark, a.source)
    out = None
    for name in [r.split for r in stored.select("split").distinct().orderBy("split").collect()]:
        rows = sampling.row_range(sampling.numbered(stored.where(F.col("split") == name), a.key), a.start, a.end, a.size)
        root = f"{a.output}.checkpoints/{name}"
        repair.build_checkpoints(rows, root, a.rows_a_chunk, fraction=a.fraction, seed=a.seed, resume=a.resume, least_mse=a.least_mse, least_share=a.least_share)
        part = repair.read_checkpoints(spark, root).select(*schemas.REPAIR.names).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        sinks.save_splits(out, a.output)


def evaluate_command(spark, a):
    """Generate a drawing for each row of a table (output_index, filename, svg, prompt), with files for each example, results and their summary."""
    rows = spark.read.parquet(a.source)
    answers = predictions.generated(rows, predictions.OfflineGenerator())
    both = materialize(rows.join(answers, "output_index"), "answers")
    found = materialize(predictions.evaluated(both).join(both.select("output_index", "filename", "svg", "text", "latency_seconds", "request_error"), "output_index"), "evaluated")
    sinks.save_examples(found, f"{a.output}/examples")
    results = found.drop("prediction_png", "target_png", "svg", "text", "prediction_svg")
    sinks.write_results(results, evaluation.summarized(results), a.output)


def external_command(spark, a):
    """The same for examples that have no result under the output yet, by a provider's calls; the summary is of all."""
    rows = spark.read.parquet(a.source)
    place = f"{a.output}/results.parquet"
    done = spark.read.parquet(place) if tables.exists(spark, place) else None
    todo = predictions.to_call(rows, done, a.overwrite)
    answers = predictions.generated(todo, predictions.OfflineGenerator())
    both = materialize(todo.join(answers, "output_index"), "answers")
    found = predictions.evaluated(both).join(both.select("output_index", "filename", "latency_seconds", "request_error"), "output_index").drop("prediction_png", "target_png")
    sinks.replace(found if done is None or a.overwrite else done.unionByName(found), place)
    results = spark.read.parquet(place)
    sinks.write_results(results, evaluation.provider_summary(results).crossJoin(evaluation.summarized(results)), a.output)  # one row each


def compare_command(spark, a):
    models = a.models.split(",")
    scores = spark.read.parquet(a.source)
    common = scores.join(evaluation.common_examples(scores, models), "evaluation_index", "left_semi")
    sinks.write_comparison(evaluation.wide(common, models), evaluation.model_summary(common, models), a.output, evaluation.pairwise_wins(common, models))


def summarize_command(spark, a):
    results = tables.results(spark, a.source)
    sinks.write_results(results, evaluation.summarized(results), a.output)


_OPTIONS = {
    "statistics": (statistics_command, {}),
    "sample": (sample_command, {"dataset": str, "key": str, "size": int, "seed": int}),
    "captions": (captions_command, {"dataset": str, "key": str, "split": str}),
    "repair": (repair_command, {"key": str, "start": int, "end": int, "size": int, "per_row": int, "seed": int, "levels": str, "least_mse": float, "least_share": float}),
    "dataset": (dataset_command, {"dataset": str, "key": str}),
    "repair-build": (repair_build_command, {"key": str, "datasets": str, "start": int, "end": int, "size": int, "rows_a_chunk": int, "fraction": float, "seed": int, "resume": bool, "least_mse": float, "least_share": float}),
    "evaluate": (evaluate_command, {}),
    "external": (external_command, {"overwrite": bool}),
    "package": (package_command, {"roots": str}),
    "compare": (compare_command, {"models": str}),
    "summarize": (summarize_command, {}),
}
_DEFAULTS = {"seed": config.SEED, "split": "train", "start": 0, "per_row": 1, "levels": ",".join(config.LEVELS), "rows_a_chunk": 1000, "fraction": config.TRUNCATED_FRACTION, "resume": False, "overwrite": False, "least_mse": config.LEAST_RENDER_MSE, "least_share": config.LEAST_CHANGED_SHARE, "key": "filename"}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="svgloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in _OPTIONS.items():
        sub = commands.add_parser(name)
        sub.add_argument("source")
        sub.add_argument("output")
        for option, kind in options.items():
            sub.add_argument(f"--{option.replace('_', '-')}", default=_DEFAULTS.get(option), **({"action": "store_true"} if kind is bool else {"type": kind}))
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("svgloom").getOrCreate()
    _OPTIONS[a.command][0](ship(spark), a)


if __name__ == "__main__":
    main()

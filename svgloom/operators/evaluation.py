"""Summaries of evaluated predictions and comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom.operators import sampling


def _rate(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))


def summarized(results: DataFrame, *by: str) -> DataFrame:
    """Rates (0 of nothing) and the mean difference of those that have one (null if none has)."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"), _rate("prediction_has_svg").alias("svg_rate"), _rate("prediction_is_valid_svg").alias("valid_rate"),
        _rate("prediction_rendered").alias("render_rate"), F.count("pixel_mse").alias("mse_count"), F.avg("pixel_mse").alias("mean_pixel_mse"),
    )


def provider_summary(results: DataFrame, *by: str) -> DataFrame:
    """Mean latency, and the mean difference with 1 for what was not rendered."""
    return results.groupBy(*by).agg(F.avg("latency_seconds").alias("mean_latency_seconds"), F.avg(F.coalesce("pixel_mse", F.lit(1.0))).alias("coverage_penalized_mse"))


def wide(scores: DataFrame, models: list[str], index: str = "evaluation_index") -> DataFrame:
    """A row for each example with a column ``{model}_mse`` for each model: one aggregation, since the models are known."""
    return scores.groupBy(index).agg(*[F.max(F.when(F.col("model") == m, F.col("pixel_mse"))).alias(f"{m}_mse") for m in models])


def winners(scores: DataFrame, models: list[str], index: str = "evaluation_index") -> DataFrame:
    """The model with the least difference of each example; ties go to the one that is named first, and what has no difference cannot win."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    return scores.where((place > 0) & F.col("pixel_mse").isNotNull()).groupBy(index).agg(F.min(F.struct(F.col("pixel_mse").alias("m"), place.alias("p"), "model")).alias("w")).select(index, F.col("w.model").alias("winner"), F.col("w.m").alias("pixel_mse"))


def model_summary(scores: DataFrame, models: list[str], index: str = "evaluation_index") -> DataFrame:
    """Mean, exact median and wins of each model."""
    won = winners(scores, models, index).groupBy(F.col("winner").alias("model")).agg(F.count(F.lit(1)).alias("wins"))
    each = scores.groupBy("model").agg(F.avg("pixel_mse").alias("mean_mse")).join(medians(scores, "model", "pixel_mse", "median_mse"), "model", "left")
    return each.join(F.broadcast(won), "model", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def medians(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The exact median of each group from ranks of a sort over the cluster: no task holds a group's values."""
    sound = df.where(F.col(value).isNotNull()).select(by, value)
    ranked = sampling.numbered_in(sound, (by,), value, name="__r")
    sizes = sound.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    middle = ranked.join(F.broadcast(sizes), by).where((F.col("__r") == F.floor((F.col("__n") - 1) / 2)) | (F.col("__r") == F.floor(F.col("__n") / 2)))
    return middle.groupBy(by).agg(F.avg(value).alias(name))


def pairwise_wins(scores: DataFrame, models: list[str], index: str = "evaluation_index") -> DataFrame:
    """For each two models how often one is strictly better than the other: all pairs of columns of one wide row, so no join of the scores with themselves."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = wide(scores, models, index)
    entries = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"{a}_mse").alias("x"), F.col(f"{b}_mse").alias("y")) for a, b in pairs])
    return row.select(F.inline(entries)).groupBy("first", "second").agg(F.count_if(F.col("x") < F.col("y")).alias("first_wins"), F.count_if(F.col("y") < F.col("x")).alias("second_wins"))


def macro_validation(losses: DataFrame, most_batches: int, task: str = "task", order: str = "batch") -> DataFrame:
    """Mean loss of each task's first batches, and ``all``: the plain mean of the tasks' means."""
    first = losses.withColumn("__r", F.row_number().over(Window.partitionBy(task).orderBy(order))).where(F.col("__r") <= most_batches)
    tasks = first.groupBy(task).agg(F.avg("loss").alias("loss"))
    return tasks.unionByName(tasks.agg(F.avg("loss").alias("loss")).withColumn(task, F.lit("all")))


def manifest_examples(manifest: DataFrame, task: str = "image") -> DataFrame:
    """Rows of a manifest's task with the place of each as output_index."""
    return manifest.select(F.posexplode(f"tasks.{task}").alias("output_index", "e")).select("output_index", "e.evaluation_index", "e.filename")


def aligned(examples: DataFrame, by_evaluation: dict[str, DataFrame], by_output: dict[str, DataFrame]) -> DataFrame:
    """Scores (output_index, evaluation_index, filename, model, pixel_mse) of several models for the same examples.

    The results of some are filed under evaluation_index, those of others under output_index. A model without a
    result for an example is an error.
    """
    out = None
    for key, tables in (("evaluation_index", by_evaluation), ("output_index", by_output)):
        for model, results in tables.items():
            part = examples.join(results.select(key, "pixel_mse", F.lit(True).alias("__have")), key, "left").select("output_index", "evaluation_index", "filename", F.lit(model).alias("model"), "pixel_mse", "__have")
            out = part if out is None else out.unionByName(part)
    lacking = F.concat(F.lit("no result of "), "model", F.lit(" for example "), F.col("output_index").cast("string"))
    # the check is a filter that never drops a row, so that no column pruning takes it away
    return out.where(F.col("__have") | F.raise_error(lacking).cast("boolean")).drop("__have")


def assembled(examples: DataFrame, results: DataFrame) -> DataFrame:
    """Examples with their results, in order of output."""
    return examples.join(results, "output_index", "left").orderBy("output_index")


def common_examples(scores: DataFrame, models: list[str], index: str = "evaluation_index") -> DataFrame:
    """Examples that every model rendered."""
    return scores.where(F.col("pixel_mse").isNotNull() & F.col("model").isin(models)).groupBy(index).agg(F.countDistinct("model").alias("__n")).where(F.col("__n") == len(models)).select(index)

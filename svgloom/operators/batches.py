"""Token arrays: lengths, labels, padding, batches, epochs and the interleaving of tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom import config
from svgloom.functions import native
from svgloom.operators import sampling


def tokenized(text: Column, encode, end: str = "") -> Column:
    """Token ids of a text with ``end`` behind it; ``encode`` takes a list of texts and gives a list of id lists, and is loaded once in a worker."""
    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(encode([(x or "") + end for x in column]))

    return run(text)


def target_ids(svg: Column, encode, eos: str) -> Column:
    """The ids that are learned: the drawing, the end mark and a line feed."""
    return tokenized(svg, encode, eos + "\n")


def sequence_length(prompt: Column, target: Column) -> Column:
    return F.size(prompt) + F.size(target)


def fitting(df: DataFrame, length: str, columns: list[str], most: int = config.MOST_TOKENS) -> DataFrame:
    """Rows that are short enough (the limit included), with the columns that a task needs only."""
    return df.where(F.col(length) <= most).select(*columns)


def batched(df: DataFrame, size: int, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with batch_id and the place in the batch, in an order; ``by`` names what is batched apart (such as a task or a shard)."""
    return sampling.numbered_in(df, by, *order, name="__k").withColumn("batch_id", F.floor(F.col("__k") / size)).withColumn("place", (F.col("__k") % size).cast("int")).drop("__k")


def training_arrays(df: DataFrame, prompt: str = "prompt_ids", target: str = "target_ids", mask: str | None = None) -> DataFrame:
    """input_ids (prompt without its padding, then target), labels (the prompt ignored), attention_mask and token_type_ids of each row."""
    p = F.col(prompt)
    if mask:
        p = F.transform(F.filter(F.arrays_zip(p.alias("t"), F.col(mask).alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    zeros = F.array_repeat(F.lit(0), F.size(target))
    out = df.withColumn("__p", p).withColumn("input_ids", F.concat("__p", target)).withColumn("labels", F.concat(F.array_repeat(F.lit(config.IGNORED_LABEL), F.size("__p")), target))
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("token_type_ids", F.concat(F.array_repeat(F.lit(0), F.size("__p")), zeros))
    long = F.size("input_ids") > config.MOST_TOKENS
    return out.withColumn("input_ids", F.when(long, F.raise_error(F.concat(F.lit("sequence too long: "), F.size("input_ids").cast("string"))).cast("array<int>")).otherwise(F.col("input_ids"))).drop("__p")


def padded(df: DataFrame, pads: dict[str, int], by: str = "batch_id") -> DataFrame:
    """Arrays filled up at their end to the longest of their batch."""
    for name, value in pads.items():
        most = F.max(F.size(name)).over(Window.partitionBy(by))
        df = df.withColumn("__m", most).withColumn(name, F.concat(name, F.array_repeat(F.lit(value), F.col("__m") - F.size(name)))).drop("__m")
    return df


def repeated(df: DataFrame, steps: int, *order: str, by: tuple[str, ...] = (), seed: int | None = None) -> DataFrame:
    """Rows in endless epochs, cut at ``steps``: step, epoch (from 1) and the row of that step.

    A row is repeated by arithmetic, not by a join of all steps with all rows. With a ``seed`` each epoch has a
    shuffle of its own, by a hash of epoch and the first column of ``order``.
    """
    if seed is None:
        placed = sampling.numbered_in(df, by, *order, name="__r")
        mine = _sized(placed, by).where(F.col("__r") < steps).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil((F.lit(steps) - F.col("__r")) / F.col("__n")).cast("int"))))
    else:
        every = _sized(df, by).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(steps) / F.col("__n")).cast("int"))))
        mine = sampling.numbered_in(every, (*by, "epoch"), native.order_hash(F.concat_ws(":", "epoch", order[0]), seed), *order, name="__r")
    return mine.withColumn("step", (F.col("epoch") - 1) * F.col("__n") + F.col("__r")).where(F.col("step") < steps).drop("__r", "__n")


def _sized(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with __n, the rows of its group: partial counts joined back."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, list(by)) if by else df.join(F.broadcast(n))  # without groups: one row


def interleaved(df: DataFrame, steps: int, tasks: list[str], task: str, *order: str, seed: int | None = None) -> DataFrame:
    """One row of each task in each step, tasks in their given order: ``turn`` counts them through."""
    place = F.array_position(F.array(*[F.lit(t) for t in tasks]), F.col(task)) - 1
    return repeated(df.where(place >= 0), steps, *order, by=(task,), seed=seed).withColumn("turn", F.col("step") * len(tasks) + place)

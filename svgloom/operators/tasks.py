"""Training tasks: what each asks a model, how long its rows are, and its batches for training and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.functions import native
from svgloom.operators import batches, sampling, statistics

#: Turns a column of texts into a column of token ids: a built-in expression, or batches.tokenized over a library.
Encoder = Callable[[Column], Column]


@dataclass(frozen=True)
class Task:
    """``columns`` are what a batch is made of; ``prompt`` gives the messages of a row; ``image_tokens`` is what the drawing's image adds to a prompt."""

    name: str
    columns: tuple[str, ...]
    prompt: Callable[[], Column]
    has_image: bool


_IMAGE = "<image>"

TASKS: dict[str, Task] = {
    t.name: t
    for t in (
        Task("text2svg", ("text", "svg"), lambda: native.text_prompt(config.SYSTEM_MESSAGE, F.col("text")), False),
        Task("image2svg", ("svg",), lambda: native.image_prompt(config.SYSTEM_MESSAGE, F.lit(_IMAGE)), True),
        Task("repair", ("svg", "corrupted_svg"), lambda: native.repair_prompt(config.SYSTEM_MESSAGE, F.lit(_IMAGE), F.col("corrupted_svg")), True),
    )
}


def serialized(task: Task) -> Column:
    """The prompt of a row as the model reads it: its messages through the chat template."""
    return native.serialized_prompt(task.prompt())


def prompt_ids(task: Task, encode: Encoder, image_ids: Column | None = None) -> Column:
    """Ids of the prompt; a task with images begins with those of the image, if they are given."""
    ids = encode(serialized(task))
    return F.concat(image_ids, ids) if task.has_image and image_ids is not None else ids


def target_ids(encode: Encoder, eos: str = "<|im_end|>") -> Column:
    return encode(F.concat(F.col("svg"), F.lit(eos + "\n")))


def with_length(df: DataFrame, task: Task, encode: Encoder, image_ids: Column | None = None) -> DataFrame:
    """``df`` with sequence_length: tokens of prompt and target together."""
    return df.withColumn("sequence_length", batches.sequence_length(prompt_ids(task, encode, image_ids), target_ids(encode)))


def prepared(df: DataFrame, task: Task, encode: Encoder, image_ids: Column | None = None, most: int = config.MOST_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all splits that are short enough, with split, the task's columns and ``keep`` only."""
    schemas.require_columns(df, ("split", *task.columns))
    return batches.fitting(with_length(df, task, encode, image_ids), "sequence_length", ["split", *keep, *task.columns], most)


def length_counts(df: DataFrame, task: Task, encode: Encoder, image_ids: Column | None = None, most: int = config.MOST_TOKENS) -> DataFrame:
    """Rows kept and removed in each split by the limit of length."""
    measured = with_length(df, task, encode, image_ids).select("split", (F.col("sequence_length") <= most).alias("fits"))
    return statistics.kept_counts(measured, "fits", "split")


def collated(batched: DataFrame, task: Task, encode: Encoder, image_ids: Column | None = None, pad: int = 0, by: str = "batch_id") -> DataFrame:
    """Rows with batch_id turned into input_ids, labels and attention_mask, filled up to the longest row of their batch."""
    rows = batched.withColumn("prompt_ids", prompt_ids(task, encode, image_ids)).withColumn("target_ids", target_ids(encode))
    rows = batches.training_arrays(rows).drop("prompt_ids", "target_ids", "token_type_ids")
    return batches.padded(rows, {"input_ids": pad, "labels": config.IGNORED_LABEL, "attention_mask": 0}, by=by)


def loader(rows: DataFrame, key: str, size: int, epoch: int | None = None, seed: int = config.SEED) -> DataFrame:
    """Rows of one split in batches: in order of ``key``, or for training in the shuffle of an epoch."""
    order = [key] if epoch is None else [native.order_hash(F.concat_ws(":", F.lit(epoch), F.col(key)), seed), key]
    return batches.batched(rows, size, *order)


def validation_only(df: DataFrame, key: str) -> DataFrame:
    """The validation split, and of it one row at most in the place of train and test."""
    validation = df.where("split = 'val'")
    one = validation.orderBy(key).limit(1)
    return validation.unionByName(one.withColumn("split", F.lit("train"))).unionByName(one.withColumn("split", F.lit("test")))


def training_graph(base: DataFrame, repair: DataFrame, key: str, encode: Encoder, size: int, epoch: int = 1, seed: int = config.SEED, source: str = "dataset", most: int = config.MOST_TOKENS) -> dict[tuple[str, str], DataFrame]:
    """Batches by (task, split) for train and val: the text and image tasks share out the training rows by halves of each source, and the validation rows are the same for both."""
    for df in (base, repair):
        schemas.require_splits({r.split for r in df.select("split").distinct().collect()})
    halves = sampling.halves(base.where("split = 'train'"), key, source, seed)
    shared = base.where("split <> 'train'")
    inputs = {"repair": repair}
    for half, name in enumerate(("text2svg", "image2svg")):
        inputs[name] = halves.where(F.col("half") == half).drop("half").unionByName(shared)
    out = {}
    for name, df in inputs.items():
        ready = prepared(df, TASKS[name], encode, most=most, keep=(key,))
        for split in ("train", "val"):
            out[name, split] = loader(ready.where(F.col("split") == split).drop("split"), key, size, epoch if split == "train" else None, seed)
    return out

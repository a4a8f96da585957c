"""Splits that keep equal drawings together, and repair rows that follow their drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.functions import native


def with_split(df: DataFrame, svg: str = "svg", seed: int = config.SEED) -> DataFrame:
    return df.withColumn("split", native.split_of(F.col(svg), seed))


def split_lookup(source: DataFrame, svg: str = "svg", split: str = "split") -> DataFrame:
    """digest and split of every drawing; in several splits, the first of train, test, val counts."""
    place = F.array_position(F.array(*[F.lit(s) for s in config.SPLIT_PRIORITY]), F.col(split))
    least = source.where(place > 0).groupBy(native.digest(F.col(svg)).alias("digest")).agg(F.min(place).alias("__p"))
    return least.select("digest", F.element_at(F.array(*[F.lit(s) for s in config.SPLIT_PRIORITY]), F.col("__p").cast("int")).alias("split"))


def follow_split(repair: DataFrame, lookup: DataFrame, svg: str = "svg", small: bool = False) -> DataFrame:
    """Repair rows with the split of their clean drawing. ``small`` says that the lookup was counted and may be broadcast."""
    return repair.drop("split").withColumn("digest", native.digest(F.col(svg))).join(F.broadcast(lookup) if small else lookup, "digest")


def missing_targets(repair: DataFrame, lookup: DataFrame, svg: str = "svg") -> DataFrame:
    """How many clean drawings of repair rows no split holds."""
    return repair.select(native.digest(F.col(svg)).alias("digest")).join(lookup, "digest", "left_anti").agg(F.countDistinct("digest").alias("missing"))


def packaged(repair: DataFrame, relative_path: str) -> DataFrame:
    """The packaged projection: whether a row comes from a truncation folder replaces type, count and seed."""
    return schemas.conform(repair.withColumn("is_truncated", native.in_truncation_folder(F.col(relative_path))), schemas.PACKAGED)


def package(repair: DataFrame, source: DataFrame) -> DataFrame:
    """Packaged rows with split; raises if a clean drawing is in no split. Empty repair rows give empty splits."""
    lookup = split_lookup(source)
    missing = missing_targets(repair, lookup).first()["missing"]
    if missing:
        raise ValueError(f"{missing} repair targets are in no source split")
    return follow_split(repair, lookup).drop("digest")

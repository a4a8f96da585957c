"""Samples, ranges, chunks and limits. Order is always an explicit column or a hash, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom import config
from svgloom.functions import native


def hash_sample(df: DataFrame, key: str, n: int, seed: int = config.SEED) -> DataFrame:
    """``n`` rows (or all, if fewer) as a seeded shuffle gives them: a top-n of hashes, so no full sort."""
    return df.orderBy(native.order_hash(F.col(key), seed), key).limit(n)


def numbered(df: DataFrame, *order: str, start: int = 0, name: str = "row_index") -> DataFrame:
    """Rows numbered from ``start`` in an order: a sort over the cluster, then numbers by partition offsets; no task sees all rows."""
    from svgloom.session import materialize

    ordered = materialize(df.orderBy(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "numbered")
    # one row for each partition of the sort
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__first"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(offsets.drop("n")), "__p").withColumn(name, F.col("__m") - F.col("__first") + F.col("__before") + start).drop("__p", "__m", "__first", "__before")


def numbered_in(df: DataFrame, by: tuple[str, ...], *order, name: str = "place") -> DataFrame:
    """Rows numbered from 0 within their group, in an order (columns or expressions).

    A sort over the cluster by group and order; a task numbers the rows of its own partition, and only groups that go over the
    border of partitions (fewer than there are partitions) take an offset. No task sees a whole group.
    """
    from svgloom.session import materialize

    if not by:
        return numbered(df, *order, name=name)
    keys = [f"__o{k}" for k in range(len(order))]
    keyed = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys)])
    ordered = materialize(keyed.orderBy(*by, *keys).drop(*keys).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "numbered-in")
    here = ordered.withColumn("__k", F.row_number().over(Window.partitionBy("__p", *by).orderBy("__m")) - 1)
    sizes = ordered.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row at most for each border of two partitions
    over = sizes.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0").select(F.col("__p").alias("__q"), *[F.col(b).alias(f"__b_{b}") for b in by], "__before")
    same = F.col("__p") == F.col("__q")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    return here.join(F.broadcast(over), same, "left").withColumn(name, F.col("__k") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def row_range(df: DataFrame, start: int, end: int | None = None, size: int | None = None, index: str = "row_index") -> DataFrame:
    """Rows of [start, end), and no more than ``size`` of them; empty if the range is."""
    stop = end if size is None else start + size if end is None else min(end, start + size)
    inside = F.col(index) >= max(0, start)
    return df.where(inside if stop is None else inside & (F.col(index) < stop))


def chunk_of(index: Column, size: int) -> Column:
    return F.floor(index / size)


def halves(df: DataFrame, key: str, by: str, seed: int = config.SEED) -> DataFrame:
    """``df`` with ``half`` 0 or 1: equal halves of each group, by alternate places in a seeded order."""
    if by not in df.columns:
        raise ValueError(f"stratification needs the column {by}")
    return numbered_in(df, (by,), native.order_hash(F.col(key), seed), key, name="half").withColumn("half", F.col("half") % 2)


def unsound_parts(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Ids that are not in exactly one of the parts as often as in the whole: no row if the parts are disjoint and complete."""
    marked = whole.select(key, F.lit(-1).alias("__part"))
    for k, part in enumerate(parts):
        marked = marked.union(part.select(key, F.lit(k).alias("__part")))
    counted = marked.groupBy(key).agg(F.count_if(F.col("__part") < 0).alias("in_whole"), F.count_if(F.col("__part") >= 0).alias("in_parts"), F.max("__part").alias("__hi"), F.min(F.when(F.col("__part") >= 0, F.col("__part"))).alias("__lo"))
    return counted.where((F.col("in_whole") != F.col("in_parts")) | (F.col("__lo") != F.col("__hi"))).select(key, "in_whole", "in_parts")


def first_fitting(df: DataFrame, key: str, length: str, n: int, most: int = config.MOST_TOKENS, seed: int = config.SEED) -> DataFrame:
    """The first ``n`` rows of a shuffle that are short enough."""
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    return hash_sample(df.where(F.col(length) <= most), key, n, seed)


def fraction_picks(df: DataFrame, key: str, by: str, fraction: float, seed: int = config.SEED) -> DataFrame:
    """From each group the share ``fraction``, rounded half to even, one at least; nothing unless 0 < fraction <= 1."""
    if not 0 < fraction <= 1:
        return df.limit(0)
    placed = numbered_in(df, (by,), native.order_hash(F.col(key), seed), key, name="__r")
    sizes = placed.groupBy(by).agg(F.greatest(F.bround(F.count(F.lit(1)) * F.lit(float(fraction))), F.lit(1)).cast("long").alias("__k"))
    return placed.join(sizes, by).where("__r < __k").drop("__r", "__k")


def retained(df: DataFrame, path: str = "path", run: str = "run", keep: int = config.KEPT_CHECKPOINTS) -> DataFrame:
    """The ``keep`` last checkpoints of each run, by the number that their name ends in; names without one are no checkpoints."""
    step = F.nullif(F.regexp_extract(path, r"(\d+)/?$", 1), F.lit("")).cast("long")
    w = Window.partitionBy(run).orderBy(F.desc("step"), path)
    return df.withColumn("step", step).where("step is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def latest(df: DataFrame, path: str = "path") -> DataFrame:
    """The last checkpoint and its step; no path and step 0 if there is none."""
    step = F.nullif(F.regexp_extract(path, r"(\d+)/?$", 1), F.lit("")).cast("long")
    return df.withColumn("__s", step).where("__s is not null").agg(F.max_by(path, "__s").alias("path"), F.coalesce(F.max("__s"), F.lit(0)).alias("step"))

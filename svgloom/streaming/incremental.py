"""Runs that go on where the last one ended: new files of a folder only, with the offsets in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_new_files(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Apply ``work`` to the rows of files that no earlier run has seen and append the result; ends when all are done.

    ``work`` gets a streaming table and may not need its whole: projections, filters and Python stages.
    A batch that was cut off is done again and its files are written once, as sink and offsets commit together.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


class _TargetReached(Exception):
    pass


def run_until_target(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, target: int) -> int:
    """Batches of new files until ``target`` kept rows are stored; returns how many there are. Each batch is a chunk of the sink.

    A batch that begins when the target is reached ends the query before its files are done: a later run with a
    higher target reads them. Only what a batch writes is counted again.
    """
    from svgloom.sources import tables

    def kept(where: str) -> int:
        return spark.read.parquet(sink).where("keep").where(where).count() if tables.exists(spark, sink) else 0

    have: list[int] = [kept("true")]

    def batch(df: DataFrame, number: int) -> None:
        if have[0] >= target:
            raise _TargetReached(f"{have[0]} rows are kept")
        before = kept(f"chunk = {number}")  # of a run that was cut off
        work(df).write.mode("overwrite").parquet(f"{sink}/chunk={number:06d}")
        have[0] += kept(f"chunk = {number}") - before

    if have[0] >= target:
        return have[0]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _TargetReached.__name__ not in str(e):
            raise
    return have[0]

"""Connected components by alternating large-star and small-star steps.

Edges stay in the cluster: each step is a partial minimum for each node joined back to
its edges, and is written to the shared folder. The number of steps grows with the
logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
    return small.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b, of one comparable type): the component is its smallest node."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = _state(now)
    while True:
        then = materialize(_stars(now), label)
        new = _state(then)
        if new == state:
            break
        now, state = then, new
    # every edge now goes from a node to the smallest one of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has an edge to another.

    Each round hangs the neighbours of a node on the smallest of them, first the larger ones, then the others;
    the rounds end when nothing changes, after about the logarithm of the longest path. Minima are taken with
    partial sums and written before they meet the edges, so a node with very many edges is split over tasks.
    """
    found = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    found, mark = materialize(found, "edges"), None
    while True:
        now = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
        # Minima of few edges are broadcast; others are written first, so that a join with them can split a node.
        ready = F.broadcast if 2 * now[0] <= BROADCAST_ROWS else lambda df: materialize(df, "least")
        both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ready(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = ready(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        found = materialize(small.where("u <> v").distinct(), "edges")

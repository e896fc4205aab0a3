"""Connected components by alternating star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str, most_rounds: int = 100) -> DataFrame:
    """(node, root) of each node of ``edges`` (bigint a, b): the root is the smallest node reachable.

    Each round joins every edge with the smallest neighbour of one end, so work follows the number
    of edges; no component is gathered in one task. Rounds grow with the logarithm of the longest path;
    labels that have not settled after ``most_rounds`` raise.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = scratch.save(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), f"{tag}-0")
    seen = None
    for i in range(1, most_rounds + 1):
        # large star: neighbours above u move to u's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        new = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = scratch.save(new, f"{tag}-{i}")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{tag}-{i - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

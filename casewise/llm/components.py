"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _minimum(both: DataFrame) -> DataFrame:
    """u, v, m: each edge with the least of u and all its neighbours; minima are pre-aggregated."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component: its least node.

    Each round hooks every node's larger neighbours to its least neighbour, then every node
    and its smaller neighbours to their least; rounds grow with the logarithm of the longest
    chain. Stars are Parquet tables, so no round depends on an earlier round's executors.
    An empty edge table gives an empty result; loops and repeated edges change nothing.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.table(small, "stars")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(seen) == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        before, now = tuple(seen), after

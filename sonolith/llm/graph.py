"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm import scratch


def _stars(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Every node's least neighbour (itself included); links from its larger, or its smaller, neighbours to that."""
    both = edges if smaller_only else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a")
    if smaller_only:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, component (its least node) for all nodes that have an edge.

    Star steps are a combined minimum and a join each, so that nodes with many edges are
    no hot keys; every round is written to the shared folder. Rounds go on until nothing
    changes, about the logarithm of the longest path.
    """
    now = scratch.save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = tuple(state)
        large = _stars(now, smaller_only=False)
        now = scratch.save(_stars(large, smaller_only=True), "edges")

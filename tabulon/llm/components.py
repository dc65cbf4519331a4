"""Connected components of edge tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
    return r.n, r.h


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). Large: each larger neighbour of u to the smallest of u and its neighbours. Small: u's smaller
    neighbours, and u, to the smallest. A hub's rows are joined with one row, so a skewed hub is split by the engine."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable. Each round is written to the shared
    folder; rounds grow with the logarithm of the number of nodes. No edges give no rows; loops are left out."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        now = stored(small, "edges")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))

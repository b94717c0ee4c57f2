"""Connected components by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, component: every node of an edge and the smallest node it reaches.

    Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones, as
    sums in the map tasks and joins whose large partitions Spark splits, so that a node with a third of
    all edges is no single task. Rounds end when the edges stay the same, in about the logarithm of
    the longest path. Null nodes and loops are left out."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "cc")
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: every neighbour above goes to the least of node and neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every neighbour below, and the node, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = saved(small.where("a <> b").distinct(), "cc")
        forget(edges)
        edges = new
        # The same set of edges twice in a row: every node points at its component.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

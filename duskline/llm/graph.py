"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, comp: for every node of edges (a, b: long), the smallest node that it is connected with.

    Each round is a minimum by key (combined before the shuffle) and a join with it, so a node with very
    many neighbours is neither collected nor held by one task. Rounds end when the edges stay as they are.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settle(edges)
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells edge sets apart: how many, and a sum over all."""
    n, total = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first()
    return n, total

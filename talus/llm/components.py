"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) from edges a, b; nodes without an edge to another node are left out.

    Nodes are of any type with an order. Each round needs sums by node and joins, never the neighbours of a node in one
    place; the number of rounds grows with the logarithm of the size of the largest component. The sums are written before they
    are joined: adaptive execution splits a hot key only where both sides of the join are plain shuffles.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = C.cut(edges.distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(C.cut(least).hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.cut(large)
        lower = C.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.hint("merge").join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        now = C.cut(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

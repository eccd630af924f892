"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.tables import discard, materialize


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(low if few else low.hint("merge"), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low if few else low.hint("merge"), "a")
    return joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, few: bool = True) -> DataFrame:
    """(a, b) to (node, root): the least node of each component, for all nodes that have an edge to another; nodes are numbers or strings.

    A node's edges never meet in one task: stars take minima before the shuffle and joins of a hot node can be split.
    Each round is written to the shared folder; rounds end when the set of edges no longer changes. Unless few, nothing is broadcast by the size of its file.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        after = materialize(_small_star(_large_star(now, few), few))
        discard(now)
        now = after

"""Live beliefs, contradictions and who prevails, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.model import Graph
from graphloom.operators import graph as G
from graphloom.tables import apart, materialize

#: Sources of an anchor up to which all pairs of them are made.
CROWD = 300


def live_memories(graph: Graph) -> DataFrame:
    """Active memories that nothing supersedes but pending edges; superseded_in is 0."""
    over = graph.edges.filter((F.col("relation") == "supersedes") & ~F.col("pending")).select(F.col("dst").alias("node_id"))
    active = graph.nodes.filter("family = 'memory' and coalesce(status, 'active') = 'active'")
    return active.join(over, "node_id", "left_anti").withColumn("superseded_in", F.lit(0).cast("long"))


def closed_pairs(edges: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """a, b (a < b): pairs that an equivalence or a verdict (left, right, kind reconcile or supersede) closes."""
    out = edges.filter(F.col("relation").isin("equivalent_to", "duplicate_of")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if verdicts is not None:
        out = out.unionByName(verdicts.filter(F.col("kind").isin("reconcile", "supersede")).select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")))
    return out.distinct()


def shared_anchor(graph: Graph, pairs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """pairs (left_id, right_id) with their least common concerns target."""
    asked = pairs.filter("left_id is not null and right_id is not null").select(*_ordered("left_id", "right_id"), (F.col("left_id") > F.col("right_id")).alias("turned"))
    least = _shared(graph.edges.filter("relation = 'concerns'").select("src", "dst"), asked, crowd).groupBy("a", "b", "turned").agg(F.min("dst").alias("anchor"))
    return least.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("left_id"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("right_id"), "anchor")


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _shared(aims: DataFrame, asked: DataFrame, crowd: int = CROWD) -> DataFrame:
    """asked pairs (a, b, more; a <= b) with each dst of aims (src, dst) that both have, dealt by a and b unless an anchor is crowded.

    An anchor of up to crowd sources offers the pairs of its sources, which are far fewer than all anchors of every asked pair. An anchor of more sources
    is looked up for the pairs; of those there can only be few.
    """
    busy = materialize(aims.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("dst"))
    crowded = not busy.isEmpty()
    quiet = aims.join(busy, "dst", "left_anti") if crowded else aims
    offered = quiet.select(F.col("src").alias("a"), "dst").join(quiet.select(F.col("src").alias("b"), "dst"), "dst").filter("a <= b").select("a", "b", "dst")
    both = asked.join(offered, ["a", "b"])
    if crowded:
        known = aims.join(busy, "dst", "left_semi")
        left = asked.join(known.select(F.col("src").alias("a"), "dst"), "a")
        both = both.unionByName(left.join(known.select(F.col("src").alias("b"), "dst"), ["b", "dst"]))
    return both


def conflicts(graph: Graph, similar: DataFrame, nominated: DataFrame, verdicts: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """left_id, right_id (in this order), anchor, cosine, origin of the open conflicts of live memories.

    similar (left_id, right_id, anchor, cosine; a pair may come more than once) come from vectors, nominated (left_id, right_id) from a reader and count
    where they share an anchor. Pairs that an equivalence or a verdict has closed are left out. live (node_id): the live memories, where similar has no
    pairs of others. Pairs of either origin move once, by both ends; nominated ones are live as their anchors are those of live memories.
    """
    near = similar.select(*_ordered("left_id", "right_id"), "anchor", "cosine")
    if live is None:
        live = apart(materialize(live_memories(graph).select("node_id")))
        near = near.join(live.withColumnRenamed("node_id", "a"), "a", "left_semi").join(live.withColumnRenamed("node_id", "b"), "b", "left_semi")
    aims = graph.edges.filter("relation = 'concerns'").select("src", "dst").join(live.withColumnRenamed("node_id", "src"), "src", "left_semi")
    asked = nominated.filter("left_id is not null and right_id is not null").select(*_ordered("left_id", "right_id"))
    closed = closed_pairs(graph.edges, verdicts)
    near = near.join(closed, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("anchor").alias("near"), F.max("cosine").alias("cosine")).withColumn("similar", F.lit("similar"))
    named = _shared(apart(materialize(aims)), asked).join(closed, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("dst").alias("anchor")).withColumn("nominated", F.lit("nominated"))
    both = named.join(near, ["a", "b"], "full")
    return both.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.least("anchor", "near").alias("anchor"), "cosine", F.concat_ws(",", "nominated", "similar").alias("origin"))


def dominant(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (left_id, right_id) with the side of the strictly stronger provenance tier, null for equal tiers."""
    ranked = graph.nodes.select("node_id", scores.tier_rank(scores.tier(F.col("family"), F.col("kind"), F.col("grounding"), F.col("attestation"))).alias("t"))
    side = lambda k: ranked.select(F.col("node_id").alias(k + "_id"), F.col("t").alias(k + "_t"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select("left_id", "right_id", F.when(F.col("left_t") < F.col("right_t"), F.col("left_id")).when(F.col("right_t") < F.col("left_t"), F.col("right_id")).alias("dominant"))


def classify_gc(graph: Graph, survival: DataFrame, ttl: int) -> DataFrame:
    """node_id, reason of memories that may go: superseded without references, or proposed, old and without references."""
    joined = graph.nodes.filter("family = 'memory'").select("node_id", "maturity").join(G.refs_in(graph), "node_id").join(G.supersession(graph).select("node_id", "superseded_in"), "node_id").join(survival, "node_id", "left")
    reason = F.when((F.col("superseded_in") > 0) & (F.col("refs") == 0), "superseded-churn").when((F.col("maturity") == "proposed") & (F.coalesce("survival", F.lit(0)) >= ttl) & (F.col("refs") == 0), "abandoned-proposed")
    return joined.select("node_id", reason.alias("reason")).filter("reason is not null")

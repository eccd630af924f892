"""Graph operators: audit, degrees, counters, traversal, typed reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Config
from graphloom.functions import scores
from graphloom.model import COMPOSE, CONFIDENCE, Graph
from graphloom.operators.assertions import _numbered
from graphloom.tables import discard, materialize, small

# Relations that count as references, and families that an impact query returns.
REFERRING = ["implements", "tracks", "serves", "concerns", "references"]
IMPACT = ["plan", "memory", "intent"]


def collapse_edges(edges: DataFrame, order: Column) -> DataFrame:
    """One edge of each (src, dst): the last in order."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", order).alias("relation"))


def typed_edges(graph: Graph) -> DataFrame:
    """Edges with well_typed. Nodes join by key; Spark broadcasts them only where its size statistics allow."""
    ends = lambda side: graph.nodes.select(F.col("node_id").alias(side), scores.tags(F.col("family"), F.col("kind")).alias(side + "_tags"))
    both = graph.edges.join(ends("src"), "src").join(ends("dst"), "dst")
    return both.withColumn("well_typed", scores.well_typed(F.col("relation"), F.col("src_tags"), F.col("dst_tags"))).drop("src_tags", "dst_tags")


def mistyped(graph: Graph) -> DataFrame:
    return typed_edges(graph).filter(~F.col("well_typed")).select("src", "dst", "relation")


def degrees(graph: Graph) -> DataFrame:
    """node_id, degree over distinct (src, dst) pairs; a loop counts twice, a lone node has 0. Nodes are counted along with the ends, so neither moves twice."""
    ends = graph.edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("node_id"), F.lit(1).alias("end"), F.lit(0).alias("node"))
    both = ends.unionByName(graph.nodes.select("node_id", F.lit(0).alias("end"), F.lit(1).alias("node")))
    counted = both.groupBy("node_id").agg(F.sum("end").alias("degree"), F.max("node").alias("node"))
    return counted.filter("node = 1").select("node_id", "degree")


def nearest_percentile(values: DataFrame, value: str, percent: float) -> DataFrame:
    """The nearest-rank percentile, exact, from counts by value: only distinct values are ordered."""
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    running = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    placed = counts.select("v", F.sum("c").over(running).alias("upto"), F.sum("c").over(every).alias("n"))
    at = F.least(F.col("n") - 1, F.bround((F.col("n") - 1) * (percent / 100.0)).cast("long"))
    return placed.filter(F.col("upto") > at).agg(F.min("v").alias(value))


def hubs(graph: Graph, c: Config = DEFAULTS) -> DataFrame:
    degree = materialize(degrees(graph))
    cut = nearest_percentile(degree, "degree", c.hub_percentile).select(F.greatest("degree", F.lit(c.hub_floor)).alias("cut"))
    return degree.crossJoin(F.broadcast(cut)).filter("degree >= cut").select("node_id", "degree")  # cut is one row


def refs_in(graph: Graph) -> DataFrame:
    found = graph.edges.filter(F.col("relation").isin(REFERRING)).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("refs"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def supersession(graph: Graph) -> DataFrame:
    """node_id, superseded_in, supersedes_out, accepted; pending edges do not count, repeated ones each do."""
    live = graph.edges.filter((F.col("relation") == "supersedes") & ~F.col("pending"))
    into = live.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("superseded_in"))
    out = live.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("supersedes_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = graph.nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left")
    return joined.select("node_id", zero("superseded_in"), zero("supersedes_out"), (F.coalesce("superseded_in", F.lit(0)) == 0).alias("accepted"))


def _degree_of(graph: Graph, ids: list[str]) -> dict[str, int]:
    """Degrees of a few nodes: only the edges that touch them are read."""
    here = lambda c: F.col(c).isin(ids)
    pairs = graph.edges.filter(here("src") | here("dst")).select("src", "dst").distinct()
    ends = pairs.filter(here("src")).select(F.col("src").alias("node_id")).unionAll(pairs.filter(here("dst")).select(F.col("dst").alias("node_id")))
    return {r.node_id: r.d for r in ends.groupBy("node_id").agg(F.count("*").alias("d")).collect()}


def traverse(graph: Graph, seeds: DataFrame, c: Config = DEFAULTS) -> DataFrame:
    """node_id, hops, parent, relation, place of the bounded walk from seeds (node_id, place), without regard to direction.

    Nodes enter level by level, by the place of the node that reaches them first and then by id, until node_budget nodes are in. Hubs enter but are
    walked through only as seeds. A repeated seed counts once, at its first place; of several relations of a pair the last by name counts, as in
    `collapse_edges`, and an edge away from the walked node goes before one towards it. The slice is bounded by node_budget, so the driver holds it;
    each level is one job that reads the edges of at most that many nodes. As many seeds as node_budget, or more, are all of the slice.
    """
    spark = graph.nodes.sparkSession
    once = seeds.groupBy("node_id").agg(F.min("place").alias("seed")).join(graph.nodes.select("node_id"), "node_id", "left_semi")
    first = once.orderBy("seed", "node_id").limit(c.node_budget)
    inside = {r.node_id: (0, None, None) for r in first.collect()}  # in order of entry
    if len(inside) >= c.node_budget:
        numbered = materialize(_numbered(once, ["seed", "node_id"], "place").select("node_id", "place"))
        return numbered.select("node_id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation"), "place")
    front, cut = list(inside), None
    for depth in range(1, c.max_hops + 1):
        if depth > 1 and front:
            if cut is None:
                found = nearest_percentile(degrees(graph), "degree", c.hub_percentile).first()[0]
                cut = max(c.hub_floor, found or 0)
            degree = _degree_of(graph, front)
            front = [n for n in front if degree.get(n, 0) < cut]
        if not front or len(inside) >= c.node_budget:
            break
        place = {n: i for i, n in enumerate(inside)}
        at = spark.createDataFrame([(n, place[n]) for n in front], "at string, place int")
        ends = lambda here, there, way: graph.edges.filter(F.col(here).isin(front) & ~F.col(there).isin(list(inside))).select(F.col(here).alias("at"), F.col(there).alias("next"), F.lit(way).alias("way"), "relation")
        ways = ends("src", "dst", 0).unionAll(ends("dst", "src", 1)).groupBy("at", "next", "way").agg(F.max("relation").alias("relation"))
        by = ways.join(F.broadcast(at), "at").groupBy("next").agg(F.min(F.struct("place", "at", "way", "relation")).alias("m"))  # the front: node_budget rows
        known = by.join(graph.nodes.select(F.col("node_id").alias("next")), "next", "left_semi")
        new = known.orderBy("m.place", "next").limit(c.node_budget - len(inside)).collect()
        inside |= {r.next: (depth, r.m.at, r.m.relation) for r in new}
        front = [r.next for r in new]
    rows = [(n, *facts, i) for i, (n, facts) in enumerate(inside.items())]
    return spark.createDataFrame(rows, "node_id string, hops int, parent string, relation string, place long")


#: Rows of a level of `reach` that may be broadcast.
REACH_BROADCAST = 100_000


def reach(graph: Graph, starts: DataFrame, reverse: bool = False, max_depth: int = 6, min_confidence: str = "AMBIGUOUS", relations: list[str] | None = None) -> DataFrame:
    """start, target, relation, confidence, depth: the best typed composing path from each start (node_id) to each target.

    Paths of well-typed edges without a repeated node whose relations, folded from the left in forward order, compose at every step of the walk.
    Best is the highest confidence, then the fewest hops. What can follow depends on the node and the composed state only: the relation so far going
    forward; going in reverse, what the path makes of each relation before it. So of the paths in one state a path does not go on
    if another one of no lower confidence has no more hops and no other nodes: whatever follows the one can follow the other. Each level is written before the next.
    """
    floor = CONFIDENCE.index(min_confidence) if min_confidence in CONFIDENCE else 0
    here, there = ("dst", "src") if reverse else ("src", "dst")
    edges = graph.edges if relations is None else graph.edges.filter(F.col("relation").isin(relations))
    hop = edges.select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("relation").alias("rel"), scores.rank_of(F.col("confidence")).alias("rank"))
    tagged = graph.nodes.select(F.col("node_id").alias("next"), scores.tags(F.col("family"), F.col("kind")).alias("next_tags"))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for (a, b), c in sorted(COMPOSE.items())))
    kind = "array<struct<a:string,c:string>>"

    def maps(state: Column, relation: Column) -> Column:
        """What a reverse state (null: the empty path) makes of a relation before it."""
        found = F.filter(state, lambda x: x.a == relation)
        return F.when(state.isNull(), relation).otherwise(F.get(found, F.lit(0)).getField("c"))

    if reverse:
        derived = maps(F.col("state"), F.col("rel"))
        after = F.filter(F.transform(F.filter(pairs, lambda x: x.b == F.col("rel")), lambda x: F.struct(x.a.alias("a"), maps(F.col("state"), x.c).alias("c"))), lambda x: x.c.isNotNull())
    else:
        so_far = F.get(F.col("state"), F.lit(0)).getField("c")
        composed = F.get(F.filter(pairs, lambda x: (x.a == so_far) & (x.b == F.col("rel"))), F.lit(0)).getField("c")
        derived = F.when(F.col("state").isNull(), F.col("rel")).otherwise(composed)
        after = F.array(F.struct(F.lit("").alias("a"), F.col("derived").alias("c")))
    known = starts.select(F.col("node_id").alias("next")).distinct().join(tagged, "next")
    walk = known.select(F.col("next").alias("start"), F.col("next").alias("at"), F.col("next_tags").alias("tags"), F.lit(None).cast(kind).alias("state"), F.lit(len(CONFIDENCE) - 1).alias("low"), F.array("next").alias("path"))
    walk, levels, facts = materialize(walk), [], []
    few = lambda df: F.broadcast(df) if small(df, REACH_BROADCAST) else df
    for depth in range(1, max_depth + 1):  # path: the nodes of the path, in any order
        joined = hop.join(few(walk), "at").filter(~F.array_contains("path", F.col("next"))).withColumn("derived", derived).filter("derived is not null")
        low = F.least("low", "rank")
        stepped = joined.select("start", "next", "tags", "rel", "derived", after.cast(kind).alias("state"), low.alias("low"), F.concat("path", F.array("next")).alias("path"))
        strong = stepped.filter((low if depth == 1 else F.least(F.col("low"), F.lit(1))) >= floor) if floor else stepped
        step = materialize(strong)
        source, target = ("next_tags", "tags") if reverse else ("tags", "next_tags")
        typed = tagged.join(few(step), "next").filter(scores.well_typed(F.col("rel"), F.col(source), F.col(target)))
        new = typed.groupBy("start", F.col("next").alias("at"), "derived", "state", F.array_sort("path").alias("nodes")).agg(F.max("low").alias("low"), F.first("next_tags").alias("tags")).withColumnRenamed("nodes", "path")
        for earlier in levels:  # at most max_depth
            seen = earlier.select("start", "at", "derived", F.col("state").alias("was"), F.col("low").alias("held"), F.col("path").alias("less"))
            same = (new.start == seen.start) & (new.at == seen.at) & (new.derived == seen.derived) & new.state.eqNullSafe(seen.was)
            new = new.join(seen, same & (F.col("low") <= F.col("held")) & (F.size(F.array_except("less", "path")) == 0), "left_anti")
        new = materialize(new)
        discard(step)
        facts.append(new.select("start", F.col("at").alias("target"), F.col("derived").alias("relation"), (F.col("low") if depth == 1 else F.least("low", F.lit(1))).alias("r"), F.lit(depth).alias("depth")))
        levels.append(new)
        if new.isEmpty():
            break
        walk = new
    found = facts[0]
    for more in facts[1:]:
        found = found.unionByName(more)
    best = found.groupBy("start", "target", "relation").agg(F.max(F.struct("r", (-F.col("depth")).alias("d"))).alias("b"))
    return best.select("start", "target", "relation", scores.confidence_of(F.col("b.r")).alias("confidence"), (-F.col("b.d")).alias("depth"))


def blast_radius(graph: Graph, starts: DataFrame, max_depth: int = 6) -> DataFrame:
    """Plans, memories and intents that reach the starts."""
    impact = graph.nodes.filter(F.col("family").isin(IMPACT)).select(F.col("node_id").alias("target"))
    return reach(graph, starts, True, max_depth).join(impact, "target", "left_semi")


def union_merge(ours: Graph, theirs: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by (src, dst, relation); ours win."""

    def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        both = a.withColumn("_p", F.lit(0)).unionByName(b.withColumn("_p", F.lit(1)), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in (*keys, "_p")]
        return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("_b")).select(*keys, "_b.*")

    return merge(ours.nodes, theirs.nodes, ["node_id"]), merge(ours.edges, theirs.edges, ["src", "dst", "relation"])

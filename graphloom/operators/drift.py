"""Drift of anchors, renames, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.tables import materialize, small

DRIFTING = ["implements", "concerns", "grounded_by"]
#: Anchors that are no longer their target's content, up to which they are broadcast to the edges (about 150 bytes each).
STALE_BROADCAST = 400_000


def superseded_sources(graph: Graph) -> DataFrame:
    """Nodes that any supersedes edge points at, pending ones too."""
    return graph.edges.filter(F.col("relation") == "supersedes").select(F.col("dst").alias("src")).distinct()


def soft(graph: Graph) -> DataFrame:
    """Anchored edges whose target's content is not what the anchor says.

    Each target's different anchors meet its content, not its edges; the few that are stale go to the edges, and only stale edges to what is superseded.
    """
    now = graph.nodes.filter(F.col("content_hash").isNotNull()).select(F.col("node_id").alias("dst"), "content_hash")
    anchored = graph.edges.filter(F.col("relation").isin(DRIFTING) & F.col("anchor").isNotNull())
    borne = anchored.select("dst", "anchor").distinct()
    off = materialize(borne.join(now.hint("merge"), "dst").filter(F.col("anchor") != F.col("content_hash")).select("dst", "anchor"))
    stale = anchored.join(F.broadcast(off) if small(off, STALE_BROADCAST) else off.hint("merge"), ["dst", "anchor"])
    # no anti join: Spark would take one below the join before it, to all anchored edges
    old = superseded_sources(graph).withColumn("old", F.lit(True))
    return stale.join(old.hint("merge"), "src", "left").filter("old is null").select("src", "dst", "relation")


def renames(graph: Graph) -> DataFrame:
    """src, relation, was, now: dangling targets whose anchor is the content of exactly one structure node."""
    by_hash = graph.nodes.filter((F.col("family") == "structure") & F.col("content_hash").isNotNull()).groupBy(F.col("content_hash").alias("anchor")).agg(F.count("*").alias("c"), F.min("node_id").alias("now")).filter("c = 1")
    lost = graph.dangling.filter(F.col("relation").isin(DRIFTING))
    return lost.join(by_hash, "anchor").select("src", "relation", F.col("target").alias("was"), "now")


def reanchor(graph: Graph) -> Graph:
    """The graph with the edges of renamed targets drawn to what they are called now."""
    moved = renames(graph)
    lost = graph.dangling.join(moved.select("src", "relation", F.col("was").alias("target")), ["src", "relation", "target"], "left_anti").select(*graph.dangling.columns)
    held = graph.dangling.join(moved.withColumnRenamed("was", "target"), ["src", "relation", "target"])
    new = held.select("src", F.col("now").alias("dst"), "relation", F.lit("EXTRACTED").alias("confidence"), "anchor", F.lit(False).alias("pending")).distinct()
    return Graph(graph.nodes, graph.edges.unionByName(new, allowMissingColumns=True), lost)


def hard(graph: Graph, moved: DataFrame | None = None) -> DataFrame:
    """Dangling drifting edges that no rename (moved, where they are known) explains."""
    lost = graph.dangling.filter(F.col("relation").isin(DRIFTING))
    left = lost.join((renames(graph) if moved is None else moved).select("src", "relation", F.col("was").alias("target")), ["src", "relation", "target"], "left_anti")
    return left.join(superseded_sources(graph), "src", "left_anti").select("src", F.col("target").alias("dst"), "relation")


def items(graph: Graph) -> DataFrame:
    """src, dst, relation, kind: soft, hard and renamed. A written table, as reports read it several times and it is small beside the edges."""
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    moved = materialize(renames(graph))
    now = moved.select("src", F.col("now").alias("dst"), "relation")
    return materialize(kind(soft(graph), "soft").unionByName(kind(hard(graph, moved), "hard")).unionByName(kind(now, "renamed")))


def done_tasks(graph: Graph) -> DataFrame:
    return graph.nodes.filter((F.col("family") == "plan") & (F.col("state") == "done")).select(F.col("node_id").alias("src"))


def surfaced(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    """Soft and hard items (found, where they are known), without what done tasks implement."""
    off = (items(graph) if found is None else found).filter("kind <> 'renamed'").select("src", "dst", "relation", "kind")
    open_ = off.filter("relation = 'implements'").join(done_tasks(graph), "src", "left_anti")
    return off.filter("relation <> 'implements'").unionByName(open_)


def stale_completions(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    off = (items(graph) if found is None else found).filter("kind <> 'renamed' and relation = 'implements'")
    return off.join(done_tasks(graph), "src", "left_semi").select("src", "dst", "kind")


def capped(lines: DataFrame, most: int) -> DataFrame:
    """The first lines (hard before soft, then by src and dst) and how many more there are, in one row."""
    lines = materialize(lines)
    order = F.struct(F.when(F.col("kind") == "hard", 0).otherwise(1).alias("k"), "src", "dst", "relation")
    first = lines.orderBy(order).limit(most)
    shown = first.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat_ws(" ", x.src, x.dst)).alias("shown"))
    total = lines.agg(F.count("*").alias("n"))
    return shown.crossJoin(F.broadcast(total)).select(F.array_join("shown", "; ").alias("shown"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))  # one row each


def capture_gaps(graph: Graph) -> DataFrame:
    """Done tasks that implement nothing, not even a lost target."""
    have = graph.edges.filter("relation = 'implements'").select("src").unionByName(graph.dangling.filter("relation = 'implements'").select("src"))
    return done_tasks(graph).join(have, "src", "left_anti").select(F.col("src").alias("node_id"))


def open_implemented(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    """Tasks not done that implement something, with no drift on it."""
    tasks = graph.nodes.filter("family = 'plan' and kind = 'task' and state <> 'done'").select(F.col("node_id").alias("src"))
    built = graph.edges.filter("relation = 'implements'").select("src").distinct()
    drifted = (items(graph) if found is None else found).filter("relation = 'implements' and kind <> 'renamed'").select("src").distinct()
    return tasks.join(built, "src", "left_semi").join(drifted, "src", "left_anti").select(F.col("src").alias("node_id"))


def verified_reconcile(graph: Graph, found: DataFrame | None = None) -> DataFrame:
    """Satisfied intents none of whose tracking tasks still has an implements edge without drift.

    Only tasks that track a satisfied intent, and of their edges only the ends, go on to the drift.
    """
    goals = materialize(graph.nodes.filter("family = 'intent' and status = 'satisfied'").select("node_id"))
    tracked = graph.edges.filter("relation = 'tracks'").select("src", F.col("dst").alias("node_id")).join(F.broadcast(goals) if small(goals, STALE_BROADCAST) else goals.hint("merge"), "node_id", "left_semi")
    drifted = (items(graph) if found is None else found).filter("kind <> 'renamed'").select("src", "dst")
    built = graph.edges.filter("relation = 'implements'").select("src", "dst").join(tracked.select("src").hint("merge"), "src", "left_semi")
    sound = built.join(drifted.hint("merge"), ["src", "dst"], "left_anti").select("src")
    held = tracked.join(sound.hint("merge"), "src", "left_semi").select("node_id").distinct()
    return goals.join(held, "node_id", "left_anti")


def pending_conflicts(graph: Graph) -> DataFrame:
    return graph.edges.filter("relation = 'supersedes' and pending").select("src", "dst")


def proof_obligations(graph: Graph, seeds: DataFrame) -> DataFrame:
    """node_id, n, statement: live intents whose tasks implement the seeds, by how many distinct seeds."""
    built = graph.edges.filter("relation = 'implements'").join(seeds.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", F.col("dst").alias("seed"))
    aims = graph.edges.filter("relation = 'tracks'").select("src", F.col("dst").alias("node_id"))
    live = graph.nodes.filter("family = 'intent' and coalesce(status, 'active') <> 'archived'").select("node_id", F.col("label").alias("statement"))
    pairs = built.join(aims, "src").select("node_id", "seed").distinct()
    return pairs.groupBy("node_id").agg(F.count("*").alias("n")).join(live, "node_id").select("node_id", "n", "statement")


def obligations(graph: Graph) -> DataFrame:
    """kind, key: pending conflicts, stale completions and drift, each under a key that does not change."""
    key = lambda *c: F.concat_ws("|", *c)
    a = pending_conflicts(graph).select(F.lit("conflict").alias("kind"), key("src", "dst").alias("key"))
    found = items(graph)
    b = stale_completions(graph, found).select(F.lit("stale").alias("kind"), key("src", "dst").alias("key"))
    c = surfaced(graph, found).select(F.lit("drift").alias("kind"), key("kind", "src", "dst", "relation").alias("key"))
    return a.unionByName(b).unionByName(c)


def _rank(kind) -> F.Column:
    return F.when(kind == "conflict", 0).when(kind == "stale", 1).otherwise(2)


def counts(found: DataFrame) -> DataFrame:
    """kind, c: how many obligations of each kind there are, 0 too."""
    every = found.sparkSession.createDataFrame([("conflict",), ("stale",), ("drift",)], "kind string")
    return every.join(found.groupBy("kind").agg(F.count("*").alias("c")), "kind", "left").select("kind", F.coalesce("c", F.lit(0)).alias("c"))


def notice(found: DataFrame, most: int) -> DataFrame:
    """place, kind, key, more: the first obligations, conflicts before stale completions before drift, then by key, and how many there are beyond."""
    found = materialize(found)
    first = found.orderBy(_rank(F.col("kind")), "key").limit(most)
    placed = first.select(F.row_number().over(Window.orderBy(_rank(F.col("kind")), "key")).alias("place"), "kind", "key")
    total = found.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return placed.crossJoin(F.broadcast(total))  # one row


def by_locus(graph: Graph) -> DataFrame:
    """dst, c, sources of the places whose change makes several decisions drift."""
    per = soft(graph).filter("relation = 'concerns'").groupBy("dst").agg(F.count("*").alias("c"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("sources"))
    return per.filter("c > 1")


def upheld(graph: Graph, seeds: DataFrame) -> DataFrame:
    """node_id of the memories that concern the seeds (node_id) and have drifted on none of them."""
    about = graph.edges.filter("relation = 'concerns'").join(seeds.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()
    off = items(graph).filter("kind <> 'renamed'").select("src", "dst").distinct()
    drifted = about.join(off, ["src", "dst"], "left_semi").select("src").distinct()
    return about.select("src").distinct().join(drifted, "src", "left_anti").select(F.col("src").alias("node_id"))


def unseen(found: DataFrame, latch: DataFrame) -> DataFrame:
    """Obligations (kind, key) that a session's latch (key) has not announced."""
    return found.join(latch.select("key").distinct(), "key", "left_anti").select("kind", "key")


def premise_holds(graph: Graph, premises: DataFrame, counters: DataFrame) -> DataFrame:
    """premises (belief, ref) with holds: the ref exists, is no archived intent and no superseded memory."""
    state = graph.nodes.select(F.col("node_id").alias("ref"), "family", "status").join(counters.select(F.col("node_id").alias("ref"), "superseded_in"), "ref")
    holds = F.when(F.col("family").isNull(), False).when(F.col("family") == "intent", F.coalesce("status", F.lit("active")) != "archived").when(F.col("family") == "memory", F.col("superseded_in") == 0).otherwise(True)
    return premises.join(state, "ref", "left").select("belief", "ref", holds.alias("holds"))


def status(graph: Graph, counters: DataFrame) -> DataFrame:
    """One row of counts."""
    nodes = graph.nodes.join(counters.select("node_id", "superseded_in"), "node_id")
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    counts = nodes.agg(
        n("family = 'structure' and kind not in ('file', 'module')", "symbols"),
        n("family = 'intent'", "intents"),
        n("family = 'plan' and kind = 'task'", "tasks"),
        n("family = 'plan' and kind = 'task' and state <> 'done'", "open_tasks"),
        n("family = 'memory' and coalesce(status, 'active') = 'active' and superseded_in = 0", "decisions"),
    )
    found = items(graph)
    drift = surfaced(graph, found).agg(F.count("*").alias("drift"))
    stale = stale_completions(graph, found).agg(F.count("*").alias("stale"))
    conflicts = pending_conflicts(graph).agg(F.count("*").alias("conflicts"))
    return counts.crossJoin(drift).crossJoin(stale).crossJoin(conflicts)  # one row each

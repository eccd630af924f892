"""Reads of the graph as packets: by topic, by file, at the start of a session; and the view of one node.

Scores, walk, ranks and reports are DataFrame operations over the whole graph; what reaches the driver is the slice (at most node_budget nodes and
their edges out) and the first lines of each report, which config bounds.
"""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Config
from graphloom.functions import scores, text
from graphloom.model import Graph
from graphloom.operators import beliefs, drift, render, retrieval
from graphloom.operators import graph as G
from graphloom.tables import apart, materialize

#: Ids of a slice: a list of up to node_budget, or a table (node_id) of more, which the seeds of a large file can be.
Ids = list[str] | DataFrame


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that graphs may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def searchable(nodes: DataFrame) -> DataFrame:
    """node_id, text: what a node is matched against, by family."""
    some = lambda name, family: F.when(F.col("family") == family, _col(nodes, name))
    scenarios = F.when(F.col("family") == "intent", F.array_join(_col(nodes, "scenarios", "array<string>"), " "))
    parts = ["node_id", "label", some("statement", "intent"), scenarios, some("design", "intent"), some("statement", "memory"), some("why", "memory"), some("alternatives", "memory"), some("kind", "memory"), _col(nodes, "signature")]
    return nodes.select("node_id", F.concat_ws(" ", *parts).alias("text"))


def lexical(graph: Graph, query: str) -> DataFrame:
    """node_id, score of the nodes that match the query's terms."""
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(text.terms(F.col("q"))).first()[0]
    if not asked:
        return spark.createDataFrame([], "node_id string, score double")
    docs = searchable(graph.nodes)
    terms = retrieval.postings(docs, "text")
    return retrieval.match_scores(terms, retrieval.idf(terms, docs), asked)


def low_confidence(semantic: DataFrame | None, query: str, c: Config = DEFAULTS) -> str | None:
    """A note where vectors were compared and none is near."""
    best = None if semantic is None else semantic.agg(F.max("score")).first()[0]
    return None if best is None or best >= c.relevance_floor else f'  ⚠ low confidence — no memory/intent node strongly matches "{query}" (best {best:.2f} < {c.relevance_floor}); showing lexical/proximity results.'


def _ids(nodes: DataFrame, c: Config) -> Ids:
    first = [r.node_id for r in nodes.select("node_id").limit(c.node_budget + 1).collect()]
    return first if len(first) <= c.node_budget else apart(materialize(nodes.select("node_id").distinct()))


def _within(df: DataFrame, ids: Ids, *cols: str) -> DataFrame:
    """The rows of df of which one of cols is among ids."""
    if isinstance(ids, list):
        return df.filter(reduce(Column.__or__, (F.col(x).isin(ids) for x in cols))) if ids else df.limit(0)
    if len(cols) == 1:
        return df.join(ids.withColumnRenamed("node_id", cols[0]), cols[0], "left_semi").select(*df.columns)
    marked = df
    for x in cols:
        marked = marked.join(ids.select(F.col("node_id").alias(x), F.lit(True).alias("_in_" + x)), x, "left")
    return marked.filter(reduce(Column.__or__, (F.col("_in_" + x).isNotNull() for x in cols))).select(*df.columns)


def _slice(graph: Graph, hops: DataFrame, c: Config) -> tuple[DataFrame, Ids]:
    """The walked nodes with their attributes, and their ids."""
    ids = _ids(hops, c)
    return _within(graph.nodes, ids, "node_id"), ids


def _relevance(graph: Graph, nodes: DataFrame, ids: Ids, now: int, c: Config) -> DataFrame:
    """node_id, superseded_in, relevance of a slice: only its own edges are counted."""
    into = _within(graph.edges, ids, "dst")
    refs = into.filter(F.col("relation").isin(G.REFERRING)).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("refs"))
    over = into.filter((F.col("relation") == "supersedes") & ~F.col("pending")).groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("superseded_in"))
    both = nodes.join(refs, "node_id", "left").join(over, "node_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    recent = scores.recency(_col(nodes, "last_seen", "long"), F.lit(now))
    return both.select("node_id", zero("superseded_in").alias("superseded_in"), scores.relevance(zero("refs"), recent, F.col("maturity"), zero("superseded_in"), c).alias("relevance"))


def _ranked(graph: Graph, hops: DataFrame, match: DataFrame | None, now: int, c: Config) -> list[dict]:
    """The slice as attribute rows with their lines, best first."""
    nodes, ids = _slice(graph, hops, c)
    if isinstance(ids, list) and not ids:
        return []
    prior = _relevance(graph, nodes, ids, now, c)
    scored = hops.join(prior, "node_id")
    scored = scored.join(match, "node_id", "left") if match is not None else scored.withColumn("match", F.lit(0.0))
    final = materialize(retrieval.rank(scored.select("node_id", "hops", "match", "relevance"), c))
    best = [r.node_id for r in final.select("node_id").collect()]  # node_budget
    nodes, prior, hops = (df.filter(F.col("node_id").isin(best)) for df in (nodes, prior, hops))
    out: dict[str, dict[str, list[str]]] = {}
    for e in graph.edges.filter(F.col("src").isin(best)).select("src", "relation", "dst").distinct().collect():  # the edges out of what is ranked
        out.setdefault(e.src, {}).setdefault(e.relation, []).append(e.dst)
    rows = [r.asDict() for r in nodes.join(final, "node_id").join(prior.select("node_id", "superseded_in"), "node_id").join(hops.select("node_id", "parent", F.col("relation").alias("by")), "node_id").orderBy("place").collect()]
    shown = {r["node_id"] for r in rows if r["kind"] not in render.HIDDEN_KINDS and r["family"] not in render.HIDDEN_FAMILIES}
    for r in rows:
        r["line"] = render.node_line(r, out.get(r["node_id"], {})) + render.via(r, r["parent"], r["by"], shown)
    return rows


def _lines(df: DataFrame, order: list, make, most: int, tail: str) -> list[str]:
    """The first rows of a report as lines, and how many more there are."""
    df = materialize(df)
    first = [make(r) for r in df.orderBy(*order).limit(most).collect()]
    more = df.count() - len(first) if len(first) == most else 0
    return first + ([f"  … +{more} more {tail}."] if more > 0 else [])


def signals(graph: Graph, scope: Ids | None, kinds: list[str], c: Config = DEFAULTS) -> dict[str, list[str]]:
    """Signal lines by kind, of the whole graph or of what touches the nodes of scope; verified intents are always those of the whole graph."""
    def near(df: DataFrame, *cols: str) -> DataFrame:
        return df if scope is None else _within(df, scope, *cols)

    found = drift.items(graph) if {"drift", "stale", "reconcile", "task"} & set(kinds) else None
    hard_first = F.when(F.col("kind") == "hard", 0).otherwise(1)
    out: dict[str, list[str]] = {}
    if "conflict" in kinds:
        rows = near(drift.pending_conflicts(graph), "src", "dst")
        out["conflict"] = _lines(rows, ["src", "dst"], lambda r: f"  ⚠ {r.src} pending-supersedes human-attested {r.dst} — {r.dst} still holds; resolve by attesting {r.src} (human) to apply, or discard {r.src}.", c.max_signal_lines, "pending conflict(s)")
    if "drift" in kinds:
        rows = near(drift.surfaced(graph, found), "src", "dst")
        out["drift"] = _lines(rows, [hard_first, "src", "dst", "relation"], lambda r: render.drift_line(r.src, r.dst, r.relation, r.kind), c.max_drift_lines, "drifted")
    if "stale" in kinds:
        rows = near(drift.stale_completions(graph, found), "src", "dst")
        out["stale"] = _lines(rows, [hard_first, "src", "dst"], lambda r: render.stale_line(r.src, r.dst, r.kind), c.max_drift_lines, "stale completion(s)")
    if "reconcile" in kinds:
        out["reconcile"] = _lines(drift.verified_reconcile(graph, found), ["node_id"], lambda r: f"  ⚠ {r.node_id} is satisfied but not verified (no live implementing link, or it drifted)", c.max_signal_lines, "satisfied intent(s)")
    if "capture" in kinds:
        rows = near(drift.capture_gaps(graph), "node_id")
        out["capture"] = _lines(rows, ["node_id"], lambda r: f"  ⚠ {r.node_id} is done but names no implementing symbol", c.max_signal_lines, "done task(s)")
    if "task" in kinds:
        rows = near(drift.open_implemented(graph, found), "node_id")
        out["task"] = _lines(rows, ["node_id"], lambda r: f"  ⚠ {r.node_id} is open but its implementing symbol(s) exist and are current — if the work is done, check its box.", c.max_signal_lines, "open task(s)")
    return out


def _named(blocks: dict[str, list[str]], groups: list[list[str]]) -> set[str]:
    """The ids that signal lines name."""
    every = " ".join([*(x for lines in blocks.values() for x in lines), *(x for g in groups for x in g)])
    return set(re.findall(text.LOCATOR_IN_TEXT, every))


def context(graph: Graph, query: str, semantic: DataFrame | None = None, family: str | None = None, grounding: str | None = None, budget: int | None = None, now: int | None = None, c: Config = DEFAULTS) -> render.Packet:
    """The packet of a topic: seeds by words (and by vectors, semantic: node_id, score), a bounded walk, ranks, reports on what it touches.

    family keeps one family's nodes, grounding one tier of memories (other families stay). Nothing found: an empty slice with the graph's verified intents.
    """
    match = materialize(lexical(graph, query))
    first = retrieval.seeds(match, c)
    if semantic is not None:
        first = retrieval.merge_seeds(first, retrieval.seeds(semantic, c))
    hops = G.traverse(graph, first.select("node_id", "place"), c)
    held, ids = _slice(graph, hops, c)
    if family or grounding:
        wanted = held.filter(F.col("family") == family) if family else held
        wanted = wanted.filter((F.col("family") != "memory") | F.col("grounding").eqNullSafe(grounding)) if grounding else wanted
        ids = _ids(wanted, c)
        hops = _within(hops, ids, "node_id")
    near = lambda df: _within(df, ids, "node_id")
    both = retrieval.combine(near(match), near(semantic) if semantic is not None else near(match).limit(0))
    ranked = _ranked(graph, hops, both, int(time.time()) if now is None else now, c)
    blocks = signals(graph, ids, ["conflict", "drift", "stale", "reconcile", "capture", "task"], c)
    return render.packet(query, ranked, blocks, [], budget or c.query_budget, _named(blocks, []), low_confidence(semantic, query, c), c)


def locus_nodes(graph: Graph, path: str) -> DataFrame:
    """node_id, place: the file, the module and the symbols of a path, in that order; paths are compared in lower case."""
    p = path.replace("\\", "/").removeprefix("./").casefold()
    rank = F.when(F.col("node_id") == f"file:{p}", 0).when(F.col("node_id") == f"module:{p}", 1).when(F.startswith(F.col("node_id"), F.lit(f"sym:{p}#")), 2)
    return graph.nodes.select("node_id", rank.alias("rank")).filter("rank is not null").withColumn("place", F.struct("rank", "node_id"))


def obligations(graph: Graph, seeds: DataFrame, c: Config = DEFAULTS) -> list[list[str]]:
    """A group of criteria for each live intent that the seeds' tasks track, those of most seeds first."""
    governing = drift.proof_obligations(graph, seeds).orderBy(F.desc("n"), "node_id").limit(c.max_governing)
    known = graph.nodes.select("node_id", _col(graph.nodes, "scenarios", "array<string>").alias("scenarios"), _col(graph.nodes, "statement").alias("own"))
    rows = governing.join(known, "node_id").orderBy(F.desc("n"), "node_id").collect()
    return [[f"  ✔ {r.node_id}: {x}" for x in ([s for s in r.scenarios or [] if s.strip()] or [r.own or r.statement or ""])] for r in rows]


def context_for_locus(graph: Graph, path: str, budget: int | None = None, now: int | None = None, c: Config = DEFAULTS) -> render.Packet | None:
    """The packet of a touched file; None where nothing governs it and nothing near it drifted."""
    first = locus_nodes(graph, path)
    seeds = [r.node_id for r in first.orderBy("place").limit(c.node_budget).collect()]
    if not seeds:
        return None
    hops = G.traverse(graph, first, c)
    ids = _ids(hops, c)
    blocks = signals(graph, ids, ["drift", "reconcile"], c)
    governed = graph.edges.filter(F.col("relation").isin("implements", "tracks", "concerns")).join(first.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    if not blocks["drift"] and governed.isEmpty():
        return None
    groups = obligations(graph, first, c)
    ranked = _ranked(graph, hops, None, int(time.time()) if now is None else now, c)
    return render.packet(f"editing {path}", ranked, blocks, groups, budget or c.hook_budget, _named(blocks, groups), None, c)


def open_plans(graph: Graph) -> DataFrame:
    """node_id of the plans that hold a task which is not done."""
    tasks = graph.nodes.filter("coalesce(state, '') <> 'done'").select(F.col("node_id").alias("dst"))
    holds = graph.edges.filter("relation = 'contains'").join(tasks, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    plans = graph.nodes.filter((F.col("family") == "plan") & (F.col("kind") == "plan") & (F.coalesce(_col(graph.nodes, "phase"), F.lit("")) != "completed"))
    return plans.select("node_id").join(holds, "node_id", "left_semi")


def standing(graph: Graph, ids: DataFrame, now: int, c: Config = DEFAULTS) -> DataFrame:
    """node_id, relevance of ids (node_id)."""
    kept = graph.nodes.join(ids.select("node_id"), "node_id", "left_semi")
    counted = kept.join(G.refs_in(graph), "node_id").join(G.supersession(graph).select("node_id", "superseded_in"), "node_id")
    recent = scores.recency(_col(kept, "last_seen", "long"), F.lit(now))
    return counted.select("node_id", scores.relevance(F.col("refs"), recent, F.col("maturity"), F.col("superseded_in"), c).alias("relevance"))


def manifest(graph: Graph, exclude: list[str], now: int, room: int, c: Config = DEFAULTS) -> list[str]:
    """Titles of the live memories of best standing that a packet does not show, as far as there is room for them."""
    live = beliefs.live_memories(graph).filter("coalesce(maturity, '') <> 'proposed'")
    rest = live.filter(~F.col("node_id").isin(exclude)) if exclude else live
    best = standing(graph, rest, now, c).orderBy(F.desc("relevance"), "node_id").limit(c.manifest_titles)
    title = F.coalesce(_col(graph.nodes, "statement"), F.col("label"), F.lit(""))
    rows = graph.nodes.select("node_id", "kind", title.alias("title")).join(best, "node_id").orderBy(F.desc("relevance"), "node_id").collect()
    lines, spent = [], 0
    for r in rows:
        name = r.title.strip().replace("\n", " ")
        line = f"  {r.node_id} [{r.kind or 'memory'}] {name if len(name) <= 96 else name[:95].rstrip() + '…'}"
        if lines and spent + len(line) + 1 > room - len(render.MANIFEST) - 100:
            break
        lines.append(line)
        spent += len(line) + 1
    more = rest.count() - len(lines) if lines else 0
    return [render.MANIFEST, *lines, *([f"  … +{more} more not listed."] if more > 0 else [])] if lines else []


def session_context(graph: Graph, budget: int | None = None, preamble: str = "", status: str = "", now: int | None = None, c: Config = DEFAULTS) -> render.Packet | None:
    """The packet of a new session: house rules, pinned memories in full, open plans with all intents, every report, titles of the rest. None if all is empty."""
    now = int(time.time()) if now is None else now
    room = (budget or c.query_budget) * 3
    aims = graph.nodes.filter("family = 'intent'").select("node_id").unionByName(open_plans(graph))
    hops = G.traverse(graph, aims.orderBy("node_id").limit(c.node_budget).withColumn("place", F.col("node_id")), c)
    ranked = [r for r in _ranked(graph, hops, None, now, c) if not (r["kind"] == "task" and r["state"] == "done")]
    blocks = render.bounded(signals(graph, None, ["conflict", "drift", "stale", "reconcile", "capture", "task"], c), int(c.signal_share * room))
    pinned: list[str] = []
    pins: list[str] = []
    if "pinned" in graph.nodes.columns:
        marked = beliefs.live_memories(graph).filter("pinned and coalesce(maturity, '') <> 'proposed'")
        total = marked.count()
        best = standing(graph, marked, now, c).orderBy(F.desc("relevance"), "node_id").limit(c.node_budget)
        rows = graph.nodes.join(best, "node_id").orderBy(F.desc("relevance"), "node_id").collect()
        spent = 0
        for r in rows:
            line = render.node_line(r.asDict(), {})
            if pins and spent + len(line) + 1 > c.pinned_budget * 3:
                continue
            pins.append(r.node_id)
            pinned.append(line)
            spent += len(line) + 1
        if pins:
            pinned = ["Pinned — these hold regardless of what you are working on:", *pinned, *([f"  … +{total - len(pins)} pinned memory(s) elided."] if total > len(pins) else [])]
    head = [x for x in (preamble.strip(), status.rstrip()) if x]
    before = sum(len(x) + 1 for x in head + pinned)
    ranked = [r for r in ranked if r["node_id"] not in pins]
    body = render.packet("active plan & governing intents", ranked, blocks, [], max(0, (room - before - c.manifest_titles * 145) // 3), _named(blocks, []), None, c)
    full = bool(ranked) or any(blocks.values())
    parts = ["\n\n".join(head), "\n".join(pinned), body.text.rstrip() if full else ""]
    titles = manifest(graph, [*pins, *body.rendered], now, max(0, room - sum(len(p) + 2 for p in parts)), c)
    parts = [p for p in [*parts, "\n".join(titles)] if p]
    if not parts:
        return None
    return render.Packet("\n\n".join(parts) + "\n", [*pins, *body.rendered], body.total + len(pins), body.rows)


def resolve(graph: Graph, target: str) -> DataFrame:
    """node_id: the node of that id; else those whose id, or hash after mem:, begins with it in any case. One row is an answer, several are candidates."""
    low = target.casefold()
    at = F.lower("node_id")
    hit = (F.col("node_id") == target) | F.startswith(at, F.lit(low)) | F.startswith(at, F.lit("mem:" + low))
    found = graph.nodes.filter(hit).select("node_id", (F.col("node_id") == target).alias("exact"))
    some = found.agg(F.max("exact").alias("any"))
    return found.crossJoin(F.broadcast(some)).filter("exact or not any").select("node_id")  # one row


def anchor_state(graph: Graph) -> DataFrame:
    """src, dst, relation, state of all drifting edges: hard where the target is gone, soft where its content is not the anchor's, else empty."""
    now = graph.nodes.select(F.col("node_id").alias("dst"), "content_hash")
    kept = graph.edges.filter(F.col("relation").isin(drift.DRIFTING)).join(now, "dst", "left")
    state = F.when(F.col("anchor").isNotNull() & F.col("content_hash").isNotNull() & (F.col("anchor") != F.col("content_hash")), "soft").otherwise("")
    gone = graph.dangling.filter(F.col("relation").isin(drift.DRIFTING)).select("src", F.col("target").alias("dst"), "relation", F.lit("hard").alias("state"))
    return kept.select("src", "dst", "relation", state.alias("state")).unionByName(gone)


def neighbourhood(graph: Graph, ids: DataFrame) -> DataFrame:
    """node_id, way (out, in, lost), relation, other: all edges of ids (node_id)."""
    side = lambda here, there, way: graph.edges.join(ids.select(F.col("node_id").alias(here)).distinct(), here, "left_semi").select(F.col(here).alias("node_id"), F.lit(way).alias("way"), "relation", F.col(there).alias("other"))
    lost = graph.dangling.join(ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node_id"), F.lit("lost").alias("way"), "relation", F.col("target").alias("other"))
    return side("src", "dst", "out").unionByName(side("dst", "src", "in")).unionByName(lost)


def reverifiable(graph: Graph) -> DataFrame:
    """node_id, reverifiable: whether a drifted node can be checked again. Plans that are not done, live memories, intents not archived, and all else."""
    counted = graph.nodes.join(G.supersession(graph).select("node_id", "superseded_in"), "node_id")
    holds = (
        F.when(F.col("family") == "plan", F.coalesce("state", F.lit("")) != "done")
        .when(F.col("family") == "memory", (F.coalesce("status", F.lit("active")) == "active") & (F.col("superseded_in") == 0))
        .when(F.col("family") == "intent", F.coalesce("status", F.lit("active")) != "archived")
        .otherwise(True)
    )
    return counted.select("node_id", holds.alias("reverifiable"))


def applicable(holding: DataFrame, beliefs_: DataFrame) -> DataFrame:
    """belief, applicable of beliefs (belief) from premises (belief, ref, side valid or invalid, holds): every valid one holds and no invalid one. None: applicable."""
    per = holding.groupBy("belief").agg(F.bool_and(F.when(F.col("side") == "valid", F.col("holds")).otherwise(~F.col("holds"))).alias("applicable"))
    return beliefs_.select("belief").join(per, "belief", "left").select("belief", F.coalesce("applicable", F.lit(True)).alias("applicable"))

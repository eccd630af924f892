"""Steps of the graph queries do not carry along what grows: edges are read once, and nothing of the view is broadcast by its file size."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.model import Graph
from graphloom.operators import assertions, beliefs, context, drift
from graphloom.plans import queries
from graphloom.sources import tables

SF = "/root/testdata/sf0.001"
NODE = "node_id string, family string, kind string, label string, status string, state string, maturity string, grounding string, attestation string, content_hash string"
EDGE = "src string, dst string, relation string, confidence string, anchor string, pending boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small_graph(spark, tmp_path_factory):
    """Three tasks (one is done), two parts; edges lie in a file, so that plans that read them say so."""
    none = [None] * 6
    nodes = [("sym:a", "structure", "function", "a", *none[:5], "h1"), ("sym:b", "structure", "function", "b", *none[:5], "h2")]
    nodes += [(f"task:{i}", "plan", "task", "t", None, "done" if i == 1 else "todo", *none[:4]) for i in (1, 2, 3)]
    edges = [("task:1", "sym:a", "implements", "EXTRACTED", "old", False), ("task:2", "sym:a", "implements", "EXTRACTED", "old", False), ("task:3", "sym:a", "implements", "EXTRACTED", "h1", False), ("task:3", "sym:b", "implements", "EXTRACTED", None, False)]
    where = f"{tmp_path_factory.mktemp('graph')}/all_edges"
    spark.createDataFrame(edges, EDGE).write.parquet(where)
    lost = spark.createDataFrame([("task:2", "implements", "sym:gone", "h2"), ("task:1", "implements", "sym:lost", "x")], "src string, relation string, target string, anchor string")
    return Graph(spark.createDataFrame(nodes, NODE), spark.read.parquet(where), lost)


@pytest.mark.parametrize("report", [drift.surfaced, drift.stale_completions, drift.items])
def test_reports_read_the_written_items(small_graph, report):
    assert "all_edges" not in plan(report(small_graph))


@pytest.mark.parametrize("most", [0, 10])
def test_drift_with_and_without_broadcast(small_graph, monkeypatch, most):
    monkeypatch.setattr(drift, "STALE_BROADCAST", most)
    found = {tuple(r) for r in drift.items(small_graph).collect()}
    assert found == {("task:1", "sym:a", "implements", "soft"), ("task:2", "sym:a", "implements", "soft"), ("task:1", "sym:lost", "implements", "hard"), ("task:2", "sym:b", "implements", "renamed")}
    assert {(r.src, r.kind) for r in drift.surfaced(small_graph).collect()} == {("task:2", "soft")}
    assert {(r.src, r.dst, r.kind) for r in drift.stale_completions(small_graph).collect()} == {("task:1", "sym:a", "soft"), ("task:1", "sym:lost", "hard")}
    assert {(r.kind, r.key) for r in drift.obligations(small_graph).collect()} == {("stale", "task:1|sym:a"), ("stale", "task:1|sym:lost"), ("drift", "soft|task:2|sym:a|implements")}


def test_only_stale_edges_meet_what_is_superseded(spark, small_graph):
    """The anti join does not sink to all anchored edges."""
    assert "LeftAnti" not in plan(drift.soft(small_graph))
    over = spark.createDataFrame([("task:9", "task:2", "supersedes", "EXTRACTED", None, True), ("task:8", "task:2", "supersedes", "EXTRACTED", None, False)], EDGE)
    assert [tuple(r) for r in drift.soft(Graph(small_graph.nodes, small_graph.edges.unionByName(over), small_graph.dangling)).collect()] == [("task:1", "sym:a", "implements")]


@pytest.mark.parametrize("most", [0, 10])
def test_reconcile_of_satisfied_intents(spark, small_graph, monkeypatch, most):
    """int:1 has a task without drift, int:2 and int:5 only ones that drift or have no edge, int:3 has no task, int:4 is not satisfied."""
    monkeypatch.setattr(drift, "STALE_BROADCAST", most)
    goals = spark.createDataFrame([(f"int:{i}", "intent", "goal", "g", "active" if i == 4 else "satisfied", *[None] * 5) for i in range(1, 6)], NODE)
    aims = spark.createDataFrame([(f"task:{t}", f"int:{i}", "tracks", "EXTRACTED", None, False) for t, i in ((3, 1), (1, 1), (2, 2), (1, 2), (4, 5), (1, 4))], EDGE)
    graph = Graph(small_graph.nodes.unionByName(goals), small_graph.edges.unionByName(aims), small_graph.dangling)
    assert sorted(r.node_id for r in drift.verified_reconcile(graph).collect()) == ["int:2", "int:3", "int:5"]
    assert sorted(r.node_id for r in drift.verified_reconcile(Graph(graph.nodes, graph.edges.filter("src <> 'task:3'"), graph.dangling), drift.items(graph)).collect()) == ["int:1", "int:2", "int:3", "int:5"]


def test_reconcile_moves_only_ends_of_built_edges(spark):
    assert not re.search(r"hashpartitioning\(src#\d+, dst#\d+, relation#", plan(queries.verified_reconcile(spark, SF)))


@pytest.mark.parametrize("read", [context.reverifiable, context.anchor_state, drift.done_tasks])
def test_the_view_is_not_broadcast(spark, read):
    found = read(tables.graph(spark, SF))
    view = tables.graph(spark, SF).nodes.select(F.col("node_id").alias("n"))
    joined = found.join(view, found[found.columns[0]] == F.col("n"))
    for df in (found, joined):
        assert not re.search(r"BroadcastHashJoin", plan(df))


@pytest.mark.parametrize("crowd", [0, 2, 100])
def test_shared_anchor_of_quiet_and_busy_anchors(spark, crowd):
    edges = [(f"mem:{i}", f"sym:{a}", "concerns", "EXTRACTED", None, False) for a, ids in (("c", "123"), ("b", "23"), ("a", "4"), ("d", "1234")) for i in ids]
    graph = Graph(None, spark.createDataFrame([*edges, edges[0]], EDGE), None)
    pairs = spark.createDataFrame([("mem:2", "mem:3"), ("mem:3", "mem:2"), ("mem:1", "mem:3"), ("mem:4", "mem:1"), ("mem:4", "mem:4"), ("mem:1", "mem:9")], "left_id string, right_id string")
    found = {tuple(r) for r in beliefs.shared_anchor(graph, pairs, crowd).collect()}
    assert found == {("mem:2", "mem:3", "sym:b"), ("mem:3", "mem:2", "sym:b"), ("mem:1", "mem:3", "sym:c"), ("mem:4", "mem:1", "sym:d"), ("mem:4", "mem:4", "sym:a")}


@pytest.fixture(scope="module")
def disputed(spark):
    """Memories 1 to 6 on one part, 1 and 2 also on another; 4 is retired, 5 superseded, 6 only pending so; 9 is no node."""
    status = {4: "retired"}
    nodes = [(f"mem:{i}", "memory", "decision", "m", status.get(i, "active"), *[None] * 5) for i in range(1, 8)]
    edges = [(f"mem:{i}", "sym:b", "concerns", "EXTRACTED", None, False) for i in range(1, 7)] + [(f"mem:{i}", "sym:a", "concerns", "EXTRACTED", None, False) for i in (1, 2)]
    edges += [("mem:7", "mem:5", "supersedes", "EXTRACTED", None, False), ("mem:7", "mem:6", "supersedes", "EXTRACTED", None, True), ("mem:6", "mem:1", "equivalent_to", "EXTRACTED", None, False)]
    pair = "left_id string, right_id string"
    similar = spark.createDataFrame([("mem:2", "mem:1", "9", 0.5), ("mem:1", "mem:2", "8", 0.5), ("mem:1", "mem:7", "3", 0.4), ("mem:2", "mem:7", "3", 0.4), ("mem:1", "mem:4", "3", 0.4), ("mem:9", "mem:1", "3", 0.4), ("mem:6", "mem:1", "3", 0.9)], pair + ", anchor string, cosine double")
    nominated = spark.createDataFrame([("mem:2", "mem:1"), ("mem:3", "mem:2"), ("mem:2", "mem:3"), ("mem:1", "mem:3"), ("mem:1", "mem:4"), ("mem:5", "mem:2"), ("mem:1", "mem:6"), ("mem:1", "mem:7"), (None, "mem:1")], pair)
    verdicts = spark.createDataFrame([("mem:3", "mem:1", "supersede"), ("mem:7", "mem:2", "reconcile"), ("mem:1", "mem:2", "dispute")], "left string, right string, kind string")
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), None), similar, nominated, verdicts


@pytest.mark.parametrize("known", [False, True])
def test_conflicts_of_both_origins(spark, disputed, known):
    graph, similar, nominated, verdicts = disputed
    live = beliefs.live_memories(graph).select("node_id")
    if known:
        similar = similar.filter("left_id <> 'mem:9' and right_id <> 'mem:4'")
    found = {tuple(r) for r in beliefs.conflicts(graph, similar, nominated, verdicts, live if known else None).collect()}
    assert found == {("mem:1", "mem:2", "8", 0.5, "nominated,similar"), ("mem:2", "mem:3", "sym:b", None, "nominated"), ("mem:1", "mem:7", "3", 0.4, "similar")}
    assert {r.node_id for r in live.collect()} == {"mem:1", "mem:2", "mem:3", "mem:6", "mem:7"}


def test_pairs_of_conflicts_move_once(spark):
    """Pairs of either origin are dealt by both ends only; liveness is asked of vectors and anchors, not of each end of a pair."""
    steps = plan(queries.conflicts(spark, SF))
    assert not re.search(r"(left_id|right_id|\ba|\bb)#\d+\], \[\w+#\d+\], LeftSemi", steps)
    assert not re.search(r"hashpartitioning\((left|right)_id#\d+", steps)


def test_lone_ids_need_no_queue(spark):
    """A log beyond the size of one queue: one that is its own parent comes last."""
    rows = [("c", []), ("a", ["ghost"]), ("b", ["b"]), ("d", None), ("x", ["y"]), ("y", [])]
    found = assertions.causal_order(spark.createDataFrame(rows, "id string, parents array<string>"), 2)
    assert [(r.id, r.cyclic) for r in found.orderBy("place").collect()] == [("a", False), ("c", False), ("d", False), ("y", False), ("x", False), ("b", True)]
    assert found.select("place").distinct().count() == 6


def test_queue_puts_small_components_together():
    import pyarrow as pa

    n = 25_000
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:06}" for i in range(n)]), pa.array([f"{i:06}" for i in range(n)]), pa.array([[]] * n, pa.list_(pa.string()))], names=["component", "id", "parents"])
    out = list(assertions._queue(iter([batch])))
    assert len(out) == 3 and sum(len(b) for b in out) == n


def test_written_tables_of_a_history_are_not_broadcast(spark):
    said = tables.assertions(spark, SF).drop("doc_id")
    assert "BroadcastHashJoin" not in plan(assertions.fold(said).nodes)


def test_ids_beyond_a_slice_are_a_table(small_graph):
    many, few = context._ids(small_graph.nodes, Config(node_budget=2)), context._ids(small_graph.nodes, Config(node_budget=5))
    assert isinstance(few, list) and not isinstance(many, list)
    only = many.filter("node_id in ('task:1', 'sym:b')")
    for cols in (["src"], ["src", "dst"]):
        rows = lambda ids: sorted(map(tuple, context._within(small_graph.edges.select("src", "dst"), ids, *cols).collect()))
        assert rows(only) == rows(["task:1", "sym:b"]) and rows(many) == sorted(map(tuple, small_graph.edges.select("src", "dst").collect()))

"""Packets of the reads, over a small graph and over the driver's tables."""

from pathlib import Path

import pytest

from graphloom.config import Config
from graphloom.model import Graph
from graphloom.operators import context as C
from graphloom.operators import render

NODE = "node_id string, family string, kind string, label string, status string, state string, maturity string, grounding string, attestation string, content_hash string, statement string, why string, scenarios array<string>, pinned boolean, phase string"
EDGE = "src string, dst string, relation string, confidence string, anchor string, pending boolean"


@pytest.fixture(scope="module")
def graph(spark):
    def node(i, family, kind, label=None, status=None, state=None, maturity=None, grounding=None, attestation=None, content=None, statement=None, why=None, scenarios=None, pinned=False, phase=None):
        return (i, family, kind, label, status, state, maturity, grounding, attestation, content, statement, why, scenarios, pinned, phase)

    nodes = [
        node("sym:auth.py#login", "structure", "function", "login", content="h1"),
        node("sym:auth.py#logout", "structure", "function", "logout", content="h2"),
        node("file:auth.py", "structure", "file", "auth.py"),
        node("sym:other.py#plot", "structure", "function", "plot", content="h3"),
        node("int:safe-login", "intent", "requirement", "Safe login", status="satisfied", statement="Logins SHALL be safe", scenarios=["Given a wrong password, then refuse", "Given five tries, then lock"]),
        node("int:old", "intent", "requirement", "Old", status="archived", scenarios=["never"]),
        node("plan:auth", "plan", "plan", "Auth plan"),
        node("task:auth/1", "plan", "task", "write login", state="done"),
        node("task:auth/2", "plan", "task", "write logout", state="todo"),
        node("task:auth/3", "plan", "task", "measure", state="done"),
        node("mem:a", "memory", "decision", "hash", status="active", grounding="empirical", statement="Hash passwords with salt", why="leaks", pinned=True),
        node("mem:b", "memory", "constraint", "keep", status="active", grounding="inferred", statement="Keep sessions short"),
        node("mem:c", "memory", "decision", "old", status="active", statement="Store passwords in plain text"),
    ]
    edges = [
        ("plan:auth", "task:auth/1", "contains", "EXTRACTED", None, False),
        ("plan:auth", "task:auth/2", "contains", "EXTRACTED", None, False),
        ("plan:auth", "task:auth/3", "contains", "EXTRACTED", None, False),
        ("file:auth.py", "sym:auth.py#login", "contains", "EXTRACTED", None, False),
        ("task:auth/1", "sym:auth.py#login", "implements", "EXTRACTED", "h0", False),
        ("task:auth/2", "sym:auth.py#logout", "implements", "EXTRACTED", "h2", False),
        ("task:auth/1", "int:safe-login", "tracks", "EXTRACTED", None, False),
        ("task:auth/1", "int:old", "tracks", "EXTRACTED", None, False),
        ("mem:a", "sym:auth.py#login", "concerns", "EXTRACTED", "h9", False),
        ("mem:a", "mem:c", "supersedes", "EXTRACTED", None, False),
        ("mem:b", "mem:c", "supersedes", "EXTRACTED", None, True),
    ]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([], "src string, relation string, target string, anchor string"))


def test_topic(graph):
    found = C.context(graph, "login", now=0)
    assert "mem:a" in found.rendered and "sym:auth.py#login" in found.rendered and "file:auth.py" not in found.rendered
    assert "⚠ mem:a → sym:auth.py#login" in found.text and "task:auth/1: completion STALE" in found.text
    assert "int:safe-login is satisfied but not verified" in found.text and "mem:b pending-supersedes" in found.text
    assert "task:auth/3 is done but names no implementing symbol" in found.text
    assert found.text.index("Intent:") < found.text.index("Plan & tasks:") < found.text.index("Code:") < found.text.index("Decisions (why):")
    assert "— why: leaks" in found.text and "supersedes mem:c" in found.text


def test_topic_filters(graph):
    only = C.context(graph, "login", family="memory", now=0)
    assert only.rendered and all(i.startswith("mem:") for i in only.rendered)
    tier = C.context(graph, "login", grounding="empirical", now=0)
    assert {i for i in tier.rendered if i.startswith("mem:")} == {"mem:a"} and "sym:auth.py#login" in tier.rendered


def test_nothing_found(graph):
    assert C.context(graph, "zzz qqq", now=0).rendered == [] and C.context(graph, "", now=0).rendered == []


def test_small_budgets_show_what_signals_name_first(graph):
    whole = C.context(graph, "login", now=0)
    some = C.context(graph, "login", budget=whole.tokens - 60, now=0)
    assert 0 < len(some.rendered) < len(whole.rendered) and "more node(s) elided" in some.text
    assert "mem:a" in some.rendered


def test_low_confidence(graph, spark):
    weak = spark.createDataFrame([("mem:a", 0.2)], "node_id string, score double")
    assert "low confidence" in C.context(graph, "login", semantic=weak, now=0).text
    strong = spark.createDataFrame([("mem:a", 0.9)], "node_id string, score double")
    assert "low confidence" not in C.context(graph, "login", semantic=strong, now=0).text


def test_locus(graph):
    found = C.context_for_locus(graph, "Auth.py", now=0)
    assert found.text.startswith('Context for "editing Auth.py"')
    assert "✔ int:safe-login: Given a wrong password, then refuse" in found.text and "int:old:" not in found.text
    assert "⚠ mem:a → sym:auth.py#login" in found.text
    assert C.context_for_locus(graph, "other.py", now=0) is None and C.context_for_locus(graph, "gone.py", now=0) is None


def test_session(graph):
    found = C.session_context(graph, preamble="House rules.", status="1 drifted", now=0)
    assert found.text.startswith("House rules.\n\n1 drifted")
    assert "Pinned — these hold" in found.text and found.rendered[0] == "mem:a"
    assert "☐ task:auth/2" in found.text and "☑" not in found.text
    assert "mem:b [constraint] Keep sessions short" in found.text and "mem:c [" not in found.text
    assert {r.node_id for r in C.open_plans(graph).collect()} == {"plan:auth"}


def test_session_of_nothing(graph):
    nothing = Graph(graph.nodes.limit(0), graph.edges.limit(0), graph.dangling)
    assert C.session_context(nothing, now=0) is None
    assert C.session_context(nothing, preamble="Rules", now=0).text == "Rules\n"


def test_show(graph, spark):
    ids = lambda t: sorted(r.node_id for r in C.resolve(graph, t).collect())
    assert ids("mem:a") == ["mem:a"] and ids("a") == ["mem:a"] and ids("task:AUTH/") == ["task:auth/1", "task:auth/2", "task:auth/3"] and ids("zz") == []
    state = {(r.src, r.dst): r.state for r in C.anchor_state(graph).collect()}
    assert state == {("task:auth/1", "sym:auth.py#login"): "soft", ("task:auth/2", "sym:auth.py#logout"): "", ("mem:a", "sym:auth.py#login"): "soft"}
    near = C.neighbourhood(graph, spark.createDataFrame([("mem:a",)], "node_id string")).collect()
    assert {(r.way, r.relation, r.other) for r in near} == {("out", "concerns", "sym:auth.py#login"), ("out", "supersedes", "mem:c")}
    again = {r.node_id: r.reverifiable for r in C.reverifiable(graph).collect()}
    assert not again["mem:c"] and not again["task:auth/1"] and not again["int:old"] and again["mem:a"] and again["task:auth/2"]


def test_conditioned_rejections(spark):
    rows = [("m1", "x", "valid", True), ("m1", "y", "invalid", False), ("m2", "x", "valid", False), ("m3", "x", "invalid", True)]
    held = spark.createDataFrame(rows, "belief string, ref string, side string, holds boolean")
    every = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m4",)], "belief string")
    assert {r.belief: r.applicable for r in C.applicable(held, every).collect()} == {"m1": True, "m2": False, "m3": False, "m4": True}


def test_placement():
    nodes = [{"node_id": f"n{i}", "family": f} for i, f in enumerate(["structure", "structure", "memory", "structure"])]
    cost = {"n0": 40, "n1": 40, "n2": 30, "n3": 10}
    assert render.place(nodes, cost, set(), 100, {"structure": 0.5, "memory": 0.3}) == ["n0", "n2", "n3"]
    assert render.place(nodes, cost, {"n1"}, 100, {"structure": 0.5, "memory": 0.3})[0] == "n1"
    assert render.fit_groups([["a" * 50], ["b" * 30], ["c" * 5]], 20) == (["a" * 50], 2, 2)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_over_the_tables(spark):
    from graphloom.sources import tables

    g = tables.graph(spark, "/root/testdata/sf0.001")
    found = C.context(g, "Customer#000000013 germany", now=0, c=Config(node_budget=20))
    assert found.rendered and found.tokens <= 4000 + 100


def test_signals_leave_room():
    """Lines go in by turns of the kinds; what is cut is counted, and a count that is there stays."""
    blocks = {"conflict": ["a" * 9] * 3, "drift": ["b" * 9] * 50 + ["  … +7 more drifted."], "stale": [], "task": ["c" * 300]}
    got = render.bounded(blocks, 200)
    assert got["conflict"] == blocks["conflict"] and got["stale"] == [] and got["task"] == ["  … +1 more that do not fit here."]
    shown = [x for x in got["drift"] if x.startswith("b")]
    assert 0 < len(shown) < 50 and got["drift"][-2:] == [f"  … +{50 - len(shown)} more that do not fit here.", "  … +7 more drifted."]
    assert sum(len(x) + 1 for lines in got.values() for x in lines) <= 200 + 40
    assert render.bounded(blocks, 10_000) == blocks

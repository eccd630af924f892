import random

import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.model import COMPOSE, CONFIDENCE, SIGNATURES, Graph
from graphloom.operators import beliefs, drift
from graphloom.operators import graph as G

NODES = "node_id string, family string, kind string, label string, status string, state string, maturity string, grounding string, attestation string, content_hash string"
EDGES = "src string, dst string, relation string, confidence string, anchor string, pending boolean"


def build(spark, nodes, edges, dangling=()):
    full = [(*n, *[None] * (10 - len(n))) for n in nodes]
    return Graph(spark.createDataFrame(full, NODES), spark.createDataFrame([(s, d, r, *(x or ["EXTRACTED", None, False])) for s, d, r, *x in edges], EDGES), spark.createDataFrame(list(dangling), "src string, relation string, target string, anchor string"))


@pytest.fixture(scope="module")
def fixture(spark):
    sym = lambda x, kind="function": (f"sym:a.py#{x}", "structure", kind)
    nodes = [("task:m/1", "plan", "task"), ("int:x", "intent", "intent"), ("mem:1", "memory", "decision"), ("module:a.py", "structure", "module"), sym("f"), sym("g"), sym("h"), sym("C", "class"), sym("D", "class")]
    s = "sym:a.py#"
    edges = [("task:m/1", s + "f", "implements"), ("task:m/1", "int:x", "tracks"), (s + "f", s + "g", "calls"), (s + "g", s + "h", "calls"), ("module:a.py", s + "f", "contains"), ("mem:1", s + "f", "concerns"), ("mem:1", "int:x", "serves"), (s + "C", s + "D", "inherits"), (s + "D", s + "g", "calls")]
    return build(spark, nodes, edges)


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_reach_of_the_fixture(spark, fixture):
    got = {(r.target, r.relation, r.confidence, r.depth) for r in G.reach(fixture, starts(spark, "task:m/1")).collect()}
    s = "sym:a.py#"
    assert got == {(s + "f", "implements", "EXTRACTED", 1), ("int:x", "tracks", "EXTRACTED", 1), (s + "g", "depends_on", "INFERRED", 2), (s + "h", "depends_on", "INFERRED", 3)}
    assert {r.target for r in G.reach(fixture, starts(spark, s + "C")).collect()} == {s + "D"}
    sure = G.reach(fixture, starts(spark, "task:m/1"), min_confidence="EXTRACTED").collect()
    assert {r.target for r in sure} == {s + "f", "int:x"}


def test_blast_radius(spark, fixture):
    radius = lambda x: {(r.target, r.relation) for r in G.blast_radius(fixture, starts(spark, "sym:a.py#" + x)).collect()}
    assert radius("f") == {("task:m/1", "implements"), ("mem:1", "concerns")}
    assert radius("h") == {("task:m/1", "depends_on")}
    assert G.mistyped(fixture).count() == 0


def brute_reach(nodes, edges, start, reverse, depth):
    tags = {n: {f, f"{f}/{k}"} for n, f, k in nodes}
    best = {}

    def fold(rels):
        acc = rels[0]
        for r in rels[1:]:
            acc = COMPOSE.get((acc, r))
            if acc is None:
                return None
        return acc

    def walk(node, rels, confs, path):
        if len(path) > depth:
            return
        for s, d, r, c in edges:
            if (d if reverse else s) != node or (s if reverse else d) in path:
                continue
            if r in SIGNATURES and not (tags[s] & set(SIGNATURES[r][0]) and tags[d] & set(SIGNATURES[r][1])):
                continue
            nxt = s if reverse else d
            rr = [r, *rels] if reverse else [*rels, r]
            rel = fold(rr)
            if rel is None:
                continue
            cc = [*confs, CONFIDENCE.index(c)]
            rank = min(cc) if len(cc) == 1 else min(*cc, 1)
            key = (nxt, rel)
            best[key] = max(best.get(key, (-1, 0)), (rank, -len(cc)))
            walk(nxt, rr, cc, [*path, nxt])

    walk(start, [], [], [start])
    return {(t, r, CONFIDENCE[k], -d) for (t, r), (k, d) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_reach_against_enumeration(spark, seed):
    rng = random.Random(seed)
    kinds = [("structure", "function"), ("structure", "class"), ("structure", "module"), ("plan", "task"), ("intent", "intent"), ("memory", "decision")]
    nodes = [(f"n{i}", *rng.choice(kinds)) for i in range(6)]
    edges = [(a[0], b[0], rng.choice(["calls", "contains", "implements", "concerns", "tracks"]), rng.choice(CONFIDENCE)) for a in nodes for b in nodes if a != b and rng.random() < 0.6]
    graph = build(spark, nodes, [(s, d, r, c, None, False) for s, d, r, c in edges])
    for reverse in (False, True):
        got = {(r.target, r.relation, r.confidence, r.depth) for r in G.reach(graph, starts(spark, "n0"), reverse, 4).collect()}
        assert got == brute_reach(nodes, edges, "n0", reverse, 4)


def brute_walk(nodes, edges, seeds, c):
    degree = {n: 0 for n in nodes}
    near = {n: set() for n in nodes}
    for s, d in {(s, d) for s, d, _ in edges}:
        degree[s] += 1
        degree[d] += 1
        near[s].add(d)
        near[d].add(s)
    order = sorted(degree.values())
    cut = max(c.hub_floor, order[min(len(order) - 1, round(c.hub_percentile / 100 * (len(order) - 1)))])
    hops = {s: 0 for s in seeds if s in near}
    front = list(hops)
    for depth in range(1, c.max_hops + 1):
        new = []
        for n in front:
            if degree[n] >= cut and depth > 1:
                continue
            for m in sorted(near[n]):
                if m not in hops:
                    if len(hops) >= c.node_budget:
                        return hops
                    hops[m] = depth
                    new.append(m)
        front = new
    return hops


def test_bounded_walk(spark):
    rng = random.Random(1)
    names = [f"n{i:02}" for i in range(40)]
    edges = list({(a, b, "calls") for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(90)) if a != b})
    graph = build(spark, [(n, "structure", "function") for n in names], edges)
    seeds = ["n03", "n20", "gone"]
    for c in (Config(node_budget=12, hub_floor=4, hub_percentile=80), Config(hub_floor=7, hub_percentile=90), Config(max_hops=1)):
        frame = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "node_id string, place int")
        got = {r.node_id: r.hops for r in G.traverse(graph, frame, c).collect()}
        assert got == brute_walk(names, edges, seeds, c)


def test_drift_kinds(spark):
    nodes = [("task:a/1", "plan", "task", None, None, "todo"), ("sym:s#f", "structure", "function", None, None, None, None, None, None, "h1"), ("sym:s#g", "structure", "function", None, None, None, None, None, None, "h2")]
    soft = build(spark, nodes, [("task:a/1", "sym:s#f", "implements", "EXTRACTED", "old", False)])
    assert [r.kind for r in drift.items(soft).collect()] == ["soft"]
    same = build(spark, nodes, [("task:a/1", "sym:s#f", "implements", "EXTRACTED", "h1", False)])
    assert drift.items(same).count() == 0
    moved = build(spark, nodes, [], [("task:a/1", "implements", "sym:s#x", "h2")])
    assert [(r.kind, r.dst) for r in drift.items(moved).collect()] == [("renamed", "sym:s#g")]
    lost = build(spark, nodes, [], [("task:a/1", "implements", "sym:s#x", "h9")])
    assert [(r.kind, r.dst) for r in drift.items(lost).collect()] == [("hard", "sym:s#x")]
    assert drift.unseen(drift.obligations(lost), spark.createDataFrame([("hard|task:a/1|sym:s#x|implements",)], "key string")).count() == 0


def test_supersession_and_live_memories(spark):
    nodes = [(f"mem:{i}", "memory", "decision", None, "active") for i in range(4)]
    graph = build(spark, nodes, [("mem:1", "mem:0", "supersedes"), ("mem:2", "mem:0", "supersedes"), ("mem:3", "mem:1", "supersedes", "EXTRACTED", None, True)])
    counters = {r.node_id: (r.superseded_in, r.supersedes_out, r.accepted) for r in G.supersession(graph).collect()}
    assert counters == {"mem:0": (2, 0, False), "mem:1": (0, 1, True), "mem:2": (0, 1, True), "mem:3": (0, 0, True)}
    assert {r.node_id for r in beliefs.live_memories(graph).collect()} == {"mem:1", "mem:2", "mem:3"}
    assert {(r.src, r.dst) for r in drift.pending_conflicts(graph).collect()} == {("mem:3", "mem:1")}


def test_ours_win_in_a_merge(spark):
    a = build(spark, [("x", "plan", "task", "ours")], [("x", "y", "calls")])
    b = build(spark, [("x", "plan", "task", "theirs"), ("y", "plan", "task", "theirs")], [("x", "y", "calls"), ("y", "x", "calls")])
    nodes, edges = G.union_merge(a, b)
    assert {r.node_id: r.label for r in nodes.collect()} == {"x": "ours", "y": "theirs"}
    assert edges.count() == 2

"""Merge, causal order and fold of assertions, against a queue and a loop in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import assertions as A

SCHEMA = "id string, locator string, family string, attrs map<string,string>, provenance array<string>, scope array<string>, edges array<struct<relation:string,target:string,pending:boolean>>, parents array<string>"


def taken(parents: dict[str, list[str]]) -> list[str]:
    """Again and again the least id whose known parents are all taken; what is left at the end by id."""
    order: list[str] = []
    done: set[str] = set()
    while True:
        ready = [i for i in parents if i not in done and all(p in done for p in parents[i] if p in parents)]
        if not ready:
            return order + sorted(set(parents) - done)
        order.append(min(ready))
        done.add(order[-1])


def histories():
    yield {"a": [], "b": ["a"], "z": []}  # a, b, z: a child of a comes before z
    yield {f"c{i:03}": [f"c{i - 1:03}"] if i else [] for i in range(130)} | {"m": ["c129", "c010"], "a": ["m", "gone"]}
    yield {"x": ["y"], "y": ["x"], "w": ["x"], "s": ["s"], "v": ["s", "a"], "a": [], "b": ["b", "a"]}
    for seed in range(3):
        dice = random.Random(seed)
        names = [f"{dice.randrange(16**4):04x}" for _ in range(120)]
        names = list(dict.fromkeys(names))
        made = {n: dice.sample(names[:i], min(i, dice.choice([0, 1, 1, 1, 2, 3]))) for i, n in enumerate(names)}
        if seed == 2:
            made[names[5]] = [names[40]] if names[5] in made[names[40]] else made[names[5]]
            made[names[10]], made[names[60]] = [names[60]], [names[10]]
        yield made


@pytest.mark.parametrize("most", [0, 8, A.QUEUE])
def test_order_is_that_of_a_queue(spark, most):
    """Histories side by side and on their own: one task for each component, levels for all, and both."""
    several = [{f"{chr(110 - k % 3)}{i}{k}": [f"{chr(110 - k % 3)}{p}{k}" for p in above] for i, above in h.items()} for k, h in enumerate(histories())]
    for parents in ({i: p for h in several for i, p in h.items()}, next(histories())):
        rows = [(i, p or None) for i, p in parents.items()] + [(None, ["a"])]
        got = A.causal_order(spark.createDataFrame(rows, "id string, parents array<string>").repartition(3), most).orderBy("place").collect()
        want = taken(parents)
        assert [r.id for r in got] == want and [r.place for r in got] == list(range(len(want)))


def test_order_of_nothing(spark):
    assert A.causal_order(spark.createDataFrame([], "id string, parents array<string>")).count() == 0


def test_merge_does_not_depend_on_order_or_split(spark):
    dice = random.Random(1)
    rows = [(f"i{k % 5}", f"loc{k % 5}", "plan", {"label": f"l{k % 5}"}, [f"p{dice.randrange(4)}", "p0"], [f"s{dice.randrange(3)}"] if k % 2 else None, [("tracks", "t", None)], [f"q{dice.randrange(3)}"] if k % 3 else []) for k in range(60)]
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    whole = sorted(map(str, A.merge(frame(rows)).collect()))
    mixed = dice.sample(rows, len(rows))
    assert sorted(map(str, A.merge(frame(mixed).repartition(4)).collect())) == whole
    parts = [A.merge(frame(mixed[:13])), A.merge(frame(mixed[13:40])), A.merge(frame(mixed[40:]))]
    assert sorted(map(str, A.merge(parts[2].unionByName(parts[0]).unionByName(parts[1])).collect())) == whole
    by_id = {r.id: r for r in A.merge(frame(rows)).collect()}
    assert by_id["i0"].provenance == sorted({x for r in rows if r[0] == "i0" for x in r[4]}) and by_id["i0"].parents == sorted({x for r in rows if r[0] == "i0" for x in r[7]})
    # equal ids that do not say the same: the least body, whichever comes first
    twice = [("x", None, "b", None, None, None, None, None), ("x", None, "a", {"k": "1"}, None, None, None, None)]
    assert {A.merge(frame(p)).first().family for p in (twice, twice[::-1])} == {"a"}
    assert A.merge(frame(rows).limit(0)).count() == 0


def folded(rows, base=(), base_edges=(), defer=()):
    """Nodes, edges, dangling edges and declined ids, one assertion after the other."""
    by = {r[0]: r for r in rows}
    nodes = {n: {"family": f, "attrs": dict(a), "in": 0, "out": 0, "prov": None} for n, f, a in base}
    edges = {(s, d): {"relation": r, "pending": p} for s, d, r, p in base_edges}
    lost, declined = [], []
    for i in taken({r[0]: r[7] or [] for r in rows}):
        _, locator, family, attrs, provenance, _, drawn, _ = by[i]
        at = locator or i
        if family in defer and at in nodes:
            declined.append(i)
            continue
        held = nodes.setdefault(at, {"attrs": {}})
        held.update({"family": family, "prov": provenance, "in": 0, "out": 0})
        held["attrs"].update({k: v for k, v in (attrs or {}).items() if k not in A.DERIVED})
        for relation, target, pending in drawn or []:
            if target not in nodes:
                lost.append((at, relation, target, pending))
                continue
            e = edges.setdefault((at, target), {"pending": None})
            e["relation"] = relation
            if pending is not None:
                e["pending"] = pending
            if relation == "supersedes" and not pending:
                nodes[target]["in"] += 1
                held["out"] += 1
    return {n: (v["family"], v["attrs"], v["prov"], v["in"], v["out"], v["in"] == 0) for n, v in nodes.items()}, {k: (v["relation"], v["pending"]) for k, v in edges.items()}, sorted(lost, key=str), sorted(declined)


def plain(f):
    nodes = {r.node_id: (r.family, r.attrs, r.provenance, r.superseded_in, r.supersedes_out, r.accepted) for r in f.nodes.collect()}
    edges = {(r.src, r.dst): (r.relation, r.pending) for r in f.edges.collect()}
    return nodes, edges, sorted(((r.src, r.relation, r.target, r.pending) for r in f.dangling.collect()), key=str), sorted(r.id for r in f.declined.collect())


def _log(seed, n=60):
    dice = random.Random(seed)
    rows, ids = [], []
    for k in range(n):
        i = f"{dice.randrange(16**5):05x}"
        edges = [(dice.choice(["supersedes", "supersedes", "tracks"]), dice.choice([*ids, "L1", "L2", "b1", "b2", "nowhere"]), dice.choice([None, None, True, False])) for _ in range(dice.randrange(3))]
        attrs = {dice.choice(["label", "state", "accepted", "superseded_in"]): f"v{k}" for _ in range(dice.randrange(3))}
        rows.append((i, dice.choice([None, None, "L1", "L2", "L3", "b1"]), dice.choice(["plan", "memory", "structure", None]), attrs or None, [f"actor{k % 3}"] if k % 4 else None, None, edges or None, dice.sample(ids, min(len(ids), dice.randrange(3)))))
        ids.append(i)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_fold_of_random_logs(spark, seed):
    rows = _log(seed)
    got = plain(A.fold(spark.createDataFrame(random.Random(9).sample(rows, len(rows)), SCHEMA).repartition(3)))
    assert got == folded(rows)


@pytest.mark.parametrize("defer", [(), ("plan", "memory")])
def test_fold_over_a_base_with_deferral(spark, defer):
    rows = _log(7)
    base = Graph(spark.createDataFrame([("b1", "structure", "function", "one"), ("b2", "plan", None, "two")], "node_id string, family string, kind string, label string"), spark.createDataFrame([("b1", "b2", "calls", False)], "src string, dst string, relation string, pending boolean"), None)
    want = folded(rows, [("b1", "structure", {"kind": "function", "label": "one"}), ("b2", "plan", {"label": "two"})], [("b1", "b2", "calls", False)], defer)
    assert plain(A.fold(spark.createDataFrame(rows, SCHEMA), A.base_of(base), defer)) == want


def test_a_replica_gives_way_to_the_workspace(spark):
    """An echo, another actor's revision, an own earlier revision, a node of the teammate alone, and a memory that is known by its content."""
    row = lambda i, locator, family, label, parents=(): (i, locator, family, {"label": label}, None, None, None, list(parents))
    local = [row("p2", "task:a/1", "plan", "done"), row("n2", "int:x", "intent", "mine"), row("m1", None, "memory", "why")]
    remote = [row("p1", "task:a/1", "plan", "todo"), row("p2", "task:a/1", "plan", "done", ["p1"]), row("n9", "int:x", "intent", "theirs"), row("k1", "int:y", "intent", "new"), row("m1", None, "memory", "why"), row("m2", None, "memory", "other")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    events = spark.createDataFrame([("p1", "task:a/1", "me", 1), ("p2", "task:a/1", "me", 2), ("n2", "int:x", "me", 3), ("n9", "int:x", "ann", 1), ("k1", "int:y", "ann", 4), ("m1", None, "me", 5)], "id string, locator string, actor string, seq long")
    ids = spark.createDataFrame([(r[0],) for r in local], "id string")
    mine = A.fold(frame(local))
    both, apart = A.replica_fold(mine, frame(remote), events, ids)
    nodes = {r.node_id: r.attrs["label"] for r in both.nodes.collect()}
    assert nodes == {"task:a/1": "done", "int:x": "mine", "int:y": "new", "m1": "why", "m2": "other"}
    assert {r.id for r in both.declined.collect()} == {"p1", "p2", "n9", "m1"}
    assert [r.locator for r in apart.collect()] == ["int:x"]
    # an own revision that arrives after the live one is still a question
    late = events.withColumn("seq", F.when(F.col("id") == "p1", 9).otherwise(F.col("seq")))
    assert {r.locator for r in A.replica_fold(mine, frame(remote), late, ids)[1].collect()} == {"int:x", "task:a/1"}
    # without a replica nothing changes
    alone, none = A.replica_fold(mine, frame(remote).limit(0), events.limit(0), ids)
    assert {r.node_id for r in alone.nodes.collect()} == {"task:a/1", "int:x", "m1"} and none.count() == 0

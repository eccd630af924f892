"""The stored vector index: exact against brute force, refreshed by what changed, untouched blocks left alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import vector_index as V

ROWS = "id string, text string, vec array<double>"


def _data(seed=3, n=300, clusters=6, dim=8, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dim))
    raw = middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return {f"v{i:04}": (f"text {i}", raw[i] * rng.uniform(0.5, 3)) for i in range(n)}


def _frame(spark, data):
    return spark.createDataFrame([(i, t, [float(x) for x in v]) for i, (t, v) in data.items()], ROWS)


def _best(data, query, k):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    scores = sorted((-round(float(unit(v) @ unit(data[query][1])), 6), i) for i, (_, v) in data.items() if i != query)
    return [(i, -s) for s, i in scores[:k]]


def _check(spark, index, data, queries, k=5):
    asked = spark.createDataFrame([(q, [float(x) for x in data[q][1]]) for q in queries], "query string, qvec array<double>")
    got = {}
    for r in index.topk(asked, k).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.id, r.cosine))
    for q in queries:
        want = _best(data, q, k)
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([c for _, c in got[q]], [c for _, c in want], atol=1e-6)


def test_an_index_over_its_life(spark, tmp_path):
    data = _data()
    index = V.Index(spark, str(tmp_path), size=20)
    assert index.refresh(_frame(spark, data)) and not index.refresh(_frame(spark, data))
    queries = list(data)[::50]
    _check(spark, index, data, queries)
    before = {r.block: r.made for r in index.manifest().collect()}
    assert len(before) > 10

    # one text changes, one row goes, one comes: only their blocks are written
    home = {r.id: r.block for r in index.entries().collect()}
    data["v0007"] = ("other", -data["v0007"][1])
    del data["v0110"]
    data["w"] = ("new", np.ones(8))
    assert index.refresh(_frame(spark, data))
    after = {r.block: r.made for r in index.manifest().collect()}
    touched = {home["v0007"], home["v0110"]}
    assert {b for b in before if after.get(b) != before[b]} == touched and len(after) == len(before) + 1
    last = index.versions.committed()[-1]
    assert {r.block for r in index.versions.read(last, "blocks").select("block").collect()} == touched | (after.keys() - before.keys())
    assert {r.id for r in index.entries().collect()} == set(data)
    _check(spark, index, data, [*queries[1:], "v0007", "w"])
    found = {r.id: r.vec for r in index.lookup(spark.createDataFrame([("w",), ("v0110",)], "id string")).collect()}
    assert found.keys() == {"w"} and np.allclose(found["w"], np.ones(8) / np.sqrt(8))
    scores = {r.id: r.cosine for r in index.scores([1.0] * 8).collect()}
    assert len(scores) == len(data) and scores["w"] == 1.0

    # all rows go
    assert index.refresh(_frame(spark, data).limit(0)) and index.entries().count() == 0


def test_blocks_that_cannot_hold_a_neighbour_are_not_read(spark, tmp_path):
    data = _data(seed=5, clusters=12, spread=0.02, dim=16)
    index = V.Index(spark, str(tmp_path), size=30)
    index.refresh(_frame(spark, data))
    asked = spark.createDataFrame([(q, [float(x) for x in data[q][1]]) for q in list(data)[:3]], "query string, qvec array<double>")
    bounds = index._bounds(asked.select("query", V.normalised(F.col("qvec")).alias("qvec"))).collect()
    near = [b for b in bounds if b.bound > 0.99]
    assert len(near) < len(bounds) / 2
    _check(spark, index, data, list(data)[:3], k=3)


def test_vectors_of_zeros_and_more_neighbours_than_rows(spark, tmp_path):
    data = {"a": ("a", np.array([1.0, 0])), "b": ("b", np.array([0.0, 0])), "c": ("c", np.array([-1.0, 0])), "d": ("d", np.array([1.0, 0]))}
    index = V.Index(spark, str(tmp_path), size=2)
    index.refresh(_frame(spark, data))
    _check(spark, index, data, list(data), k=9)


def test_texts_are_encoded_when_they_change(spark, tmp_path):
    nodes = spark.createDataFrame([("mem:a", "memory", "decision", "a", "Hash passwords", "leaks", None, None, None), ("int:b", "intent", "requirement", "b", "Logins are safe", None, None, ["wrong password", "five tries"], "hash"), ("sym:c", "structure", "function", "c", None, None, None, None, None), ("mem:d", "memory", None, "only a label", "", None, "other", None, None)], "node_id string, family string, kind string, label string, statement string, why string, alternatives string, scenarios array<string>, design string")
    texts = {r.id: r.text for r in V.node_text(nodes).collect()}
    assert texts == {"mem:a": "decision: Hash passwords\nleaks", "int:b": "requirement: Logins are safe\nwrong password\nfive tries\nhash", "mem:d": "memory: only a label\nother"}
    asked = []

    def encoder(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return V.encode(rows)

    index = V.Index(spark, str(tmp_path))
    index.refresh(V.node_text(nodes), encoder)
    changed = nodes.withColumn("why", F.when(F.col("node_id") == "mem:a", "breaches").otherwise(F.col("why")))
    index.refresh(V.node_text(changed), encoder)
    assert asked == [["int:b", "mem:a", "mem:d"], ["mem:a"]]
    (query,) = V.encode(spark.createDataFrame([("q", "hashing a password: hash passwords")], "id string, text string")).collect()
    assert pytest.approx(1.0) == float(np.linalg.norm(query.vec))
    best = index.scores(query.vec).orderBy(F.desc("cosine")).first()
    assert best.id == "mem:a" and best.cosine > 0.4

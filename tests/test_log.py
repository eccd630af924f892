import hashlib

from pyspark.sql import functions as F

from graphloom.operators import log, retrieval
from graphloom.streaming import refold

SCHEMA = "project long, seq long, id string, session long, actor long, family string, body string"
ROWS = [(1, 1, "a", 1, 7, "x", "first"), (1, 2, "b", 1, 8, "x", "b"), (1, 3, "a", 2, 9, "x", "second"), (1, 4, "c", None, None, "y", "c"), (1, 5, "a", 2, 7, "x", "third")]


def test_collapse_keeps_the_first_body(spark):
    got = {r.id: (r.body, r.events, r.actors) for r in log.collapse(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got["a"] == ("first", 3, "7,9")
    assert {r.id: (r.seq, r.actor) for r in log.landings(spark.createDataFrame(ROWS, SCHEMA)).collect()} == {"a": (1, "7"), "b": (2, "8"), "c": (4, "unattributed")}


def test_survival_skips_the_own_session(spark):
    got = {r.id: r.survival for r in log.survival(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {"a": 3, "b": 3, "c": 1}


def test_chain(spark):
    chain = log.build_chain(spark.createDataFrame(ROWS, SCHEMA))
    first = chain.orderBy("seq").first()
    assert first.prev_hash == log.GENESIS
    assert first.entry_hash == hashlib.sha256((log.GENESIS + "\0" + first.event_key).encode()).hexdigest()
    assert log.verify_chain(chain).first().bad == 0
    broken = chain.withColumn("entry_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("entry_hash")))
    assert log.verify_chain(broken).first().first_bad == 3


def test_fold_resolves_earlier_nodes_only(spark):
    e = "rank int, id string, locator string, family string, kind string, label string, edges array<struct<relation:string,target:string,pending:boolean>>"
    rows = [(1, "i1", "mem:a", "memory", "decision", "one", [("concerns", "mem:b", False)]), (2, "i2", "mem:b", "memory", "decision", "two", [("supersedes", "mem:a", False)]), (3, "i3", "mem:a", "memory", None, "three", [])]
    nodes, edges, lost = log.fold(spark.createDataFrame(rows, e))
    assert {r.node_id: (r.label, r.kind) for r in nodes.collect()} == {"mem:a": ("three", "decision"), "mem:b": ("two", "decision")}
    assert [(r.src, r.dst) for r in edges.collect()] == [("mem:b", "mem:a")]
    assert [(r.src, r.target) for r in lost.collect()] == [("mem:a", "mem:b")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame(ROWS, SCHEMA)
    where = str(tmp_path)
    for part in (events.filter("seq <= 3"), events.filter("seq >= 3")):  # one event comes twice
        part.write.mode("append").parquet(f"{where}/in")
        refold.ingest(refold.stream(spark, f"{where}/in"), f"{where}/log", f"{where}/view", f"{where}/checkpoint").awaitTermination()
    view = refold.head(spark, f"{where}/view")
    assert sorted(view.collect()) == sorted(log.collapse(events).select(view.columns).collect())
    assert refold.is_current(view, events)


def test_stream_knows_events_by_their_key(spark, tmp_path):
    """The same event under another seq is no new one; ids that a batch does not touch are carried over; old views go."""
    where = str(tmp_path)
    parts = [ROWS[:3], [(1, 9, "a", 4, 7, "x", "first"), (2, 1, "a", 1, 7, "x", "first")], [(1, 10, "d", 1, 7, "x", "d")]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{where}/in")
        refold.ingest(refold.stream(spark, f"{where}/in"), f"{where}/log", f"{where}/view", f"{where}/checkpoint").awaitTermination()
    view = refold.head(spark, f"{where}/view")
    assert {r.id: (r.events, r.first_seq) for r in view.collect()} == {"a": (3, 1), "b": (1, 2), "d": (1, 10)}
    assert refold._folders(spark, f"{where}/view", "head") == [1, 2]


def test_chain_goes_on_from_its_tail(spark):
    events = spark.createDataFrame(ROWS, SCHEMA)
    whole = {(r.seq, r.entry_hash) for r in log.build_chain(events).collect()}
    start = log.build_chain(events.filter("seq <= 2"))
    tail = start.orderBy(F.desc("seq")).limit(1).select("project", "entry_hash")
    rest = log.build_chain(events.filter("seq > 2"), tail)
    assert {(r.seq, r.entry_hash) for r in start.unionByName(rest).collect()} == whole


def test_parents_and_projections(spark):
    rows = [("i1", "mem:a", ["x"]), ("i2", "mem:a", ["mem:b", "i1"]), ("i3", "mem:b", []), ("i4", None, ["mem:a", "i2"])]
    got = {r.id: r.parents for r in log.rewrite_parents(spark.createDataFrame(rows, "id string, locator string, parents array<string>")).collect()}
    assert got == {"i1": ["x"], "i2": ["i3", "i1"], "i3": [], "i4": ["i1", "i2"]}
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, relation string")
    drawn = spark.createDataFrame([(1, "a", "b", "contains", "m1"), (2, "a", "c", "tracks", "m1"), (3, "a", "c", "serves", "m2"), (4, "a", "b", "calls", "m3")], "rank int, src string, dst string, relation string, of string")
    taken, shadowed = log.project(edges, drawn)
    assert {(r.src, r.dst, r.relation) for r in taken.collect()} == {("a", "b", "calls"), ("a", "c", "tracks")}
    assert {(r.relation, r.of) for r in shadowed.collect()} == {("contains", "m1"), ("serves", "m2")}


def test_fold_over_a_base(spark):
    from graphloom.model import Graph

    e = "rank int, id string, locator string, family string, kind string, label string, edges array<struct<relation:string,target:string,pending:boolean>>"
    rows = [(1, "i1", "mem:a", "memory", "decision", "one", [("concerns", "sym:x", False), ("concerns", "sym:gone", False)]), (2, "i2", "sym:x", None, None, "renamed", [])]
    base = Graph(spark.createDataFrame([("sym:x", "structure", "function", "x")], "node_id string, family string, kind string, label string"), None, None)
    nodes, edges, lost = log.fold(spark.createDataFrame(rows, e), base)
    assert {r.node_id: (r.family, r.label) for r in nodes.collect()} == {"mem:a": ("memory", "one"), "sym:x": ("structure", "renamed")}
    assert [(r.src, r.dst) for r in edges.collect()] == [("mem:a", "sym:x")] and [r.target for r in lost.collect()] == ["sym:gone"]


def test_similar_pairs_in_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTORS", 7)
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(60, 5))
    raw /= np.linalg.norm(raw, axis=1)[:, None]
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in v]) for i, v in enumerate(raw)]
    frame = spark.createDataFrame(rows, "id long, anchor string, vec array<double>")
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if (i % 3 == 0) == (j % 3 == 0) and round(float(raw[i] @ raw[j]), 6) >= 0.5}
    assert {(r.left_id, r.right_id) for r in retrieval.similar_pairs(frame, 0.5).collect()} == expected
    queries = frame.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    got = {(r.query, r.place): r.id for r in retrieval.vector_topk(frame, queries, 4).collect()}
    for q in (0, 20, 40):
        best = sorted((j for j in range(60) if j != q), key=lambda j: (-round(float(raw[q] @ raw[j]), 6), j))[:4]
        assert [got[q, k + 1] for k in range(4)] == best


def test_seed_cutoff_and_merge(spark):
    match = spark.createDataFrame([("a", 10.0), ("b", 9.0), ("c", 4.0), ("d", 3.9)], "node_id string, score double")
    assert [r.node_id for r in retrieval.seeds(match).orderBy("place").collect()] == ["a", "b"]
    second = spark.createDataFrame([("z", 0), ("b", 1)], "node_id string, place int")
    assert [r.node_id for r in retrieval.merge_seeds(retrieval.seeds(match), second).orderBy("place").collect()] == ["a", "b", "z"]
    assert {r.node_id: r.match for r in retrieval.combine(match, match.limit(0)).collect()}["a"] == 1.0

"""Streams with state, in several batches and over restarts, against the batch forms."""

from graphloom.operators import log
from graphloom.streaming import state

EVENTS = "project long, seq long, id string, body string"
REPORTS = "project long, session string, at long, fingerprint string, keys array<string>"


def _run(spark, make, schema, parts, where):
    """Each part is a batch of its own and a start of its own."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        state.run(make(spark.readStream.schema(schema).parquet(f"{where}/in")), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/out")


def test_chain_over_restarts(spark, tmp_path):
    parts = [
        [(1, 1, "a", "x"), (2, 2, "a", "x"), (1, 3, "b", "y")],
        [(1, 5, "d", "z"), (1, 4, "c", "y"), (1, 9, "a", "x")],  # out of order, and one that came before
        [(2, 6, "b", "q"), (1, 7, "d", "z"), (3, 8, "a", "x"), (1, 10, "e", None)],
    ]
    got = _run(spark, state.chained, EVENTS, parts, str(tmp_path))
    # the batch chain over the events in the order in which they came in
    once = [(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "c", "y"), (1, 4, "d", "z"), (1, 5, "e", None), (2, 1, "a", "x"), (2, 2, "b", "q"), (3, 1, "a", "x")]
    want = log.build_chain(spark.createDataFrame(once, EVENTS))
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(tuple(r) for r in want.collect())
    assert all(r.bad == 0 for r in log.verify_chain(got).collect())


def test_sessions_are_told_once(spark, tmp_path):
    parts = [
        [(1, "s", 1, "f1", ["k1", "k2"]), (1, "s", 2, "f2", ["k1", "k2"]), (1, "t", 3, "f2", ["k2"])],  # told once a session
        [(1, "s", 4, "f3", ["k2"]), (1, "s", 5, "f4", ["k1", "k2"]), (2, "s", 5, "f", ["k1"]), (1, "t", 6, "f2", ["k2", "k9"])],  # k1 cleared and came back; t saw these inputs before
        [(1, "u", 7, None, None), (1, "s", 8, "f5", ["k3", "k1", "k2"])],
    ]
    got = _run(spark, state.announced, REPORTS, parts, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "s", 1, "k1"), (1, "s", 1, "k2"), (1, "s", 5, "k1"), (1, "s", 8, "k3"), (1, "t", 3, "k2"), (2, "s", 5, "k1")]
    # without equal fingerprints the table form says the same
    plain = spark.createDataFrame([r for p in parts for r in p if r[:3] != (1, "t", 6)], REPORTS)
    assert sorted(map(tuple, state.announcements(plain).collect())) == sorted(map(tuple, got.collect()))


def test_only_the_last_sessions_are_remembered(spark, tmp_path):
    parts = [[(1, f"s{i}", i, None, ["k"]) for i in range(3)], [(1, "s3", 3, None, ["k"])], [(1, "s0", 4, None, ["k"]), (1, "s3", 5, None, ["k"])]]
    got = _run(spark, lambda r: state.announced(r, sessions=3), REPORTS, parts, str(tmp_path))
    assert sorted((r.session, r.at) for r in got.collect()) == [("s0", 0), ("s0", 4), ("s1", 1), ("s2", 2), ("s3", 3)]

"""Suggestions against all pairs, and what is known at the time of reading."""

import difflib
import random

from graphloom.operators import overlay, suggest


def test_suggestions_are_those_of_all_pairs(spark):
    dice = random.Random(2)
    word = lambda: "".join(dice.choices("abcdeé-#/", k=dice.randint(1, 12)))
    known = [f"mem:{word()}" for _ in range(60)] + [f"task:{word()}/1" for _ in range(60)] + ["", None, "x", "x" * 300, "mem:a", "mem:a"]
    asked = [k[:2] + k[3:] for k in known[:120:7] if k] + ["mem:zzzz", "nothing like it", "", None, "x" * 290 + "y", "x", "mem:a"]
    got = {}
    for r in suggest.suggest(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(k,) for k in known], "id string")).orderBy("asked", "place").collect():
        got.setdefault(r.asked, []).append(r.suggestion)
    have = {k for k in known if k}
    want = {a: difflib.get_close_matches(a, have, n=3, cutoff=0.6) for a in asked if a}
    assert got == {a: w for a, w in want.items() if w}


def test_counters_as_of_a_read(spark):
    counters = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 5, 2, 1.0), ("a", 5, 3, 0.0), ("b", 9, 1, 0.1), ("c", 1, None, None)], "node_id string, ts long, usage long, upholds double")
    reads = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 5), ("a", 99), ("b", 8), ("c", 2), ("d", 2), ("a", 4)], "node_id string, at long")
    got = sorted((tuple(r) for r in overlay.as_of(reads, counters).collect()), key=str)
    assert got == sorted([("a", 0, None, None), ("a", 1, 1, 0.5), ("a", 4, 1, 0.5), ("a", 4, 1, 0.5), ("a", 5, 3, 0.0), ("a", 99, 3, 0.0), ("b", 8, None, None), ("c", 2, None, None), ("d", 2, None, None)], key=str)


def test_maturity_as_read(spark):
    memories = spark.createDataFrame([("p", "proposed", 0), ("q", "proposed", 0), ("w", "working", 0), ("s", "working", 1), ("n", "settled", 0)], "node_id string, maturity string, superseded_in long")
    counters = spark.createDataFrame([("p", 1, 4, 1, 0.5), ("q", 1, 4, 1, 1.5), ("w", 1, 9, 2, 3.0), ("s", 1, 9, 2, 9.0), ("w", 7, 10, 3, 0.0), ("ghost", 1, 1, 1, 9.0)], "node_id string, ts long, usage long, last_seen long, upholds double")
    commits = spark.createDataFrame([("w", 2), ("p", 5)], "node_id string, survival long")
    shared = spark.createDataFrame([("w", 7), ("x", 1)], "node_id string, survival long")
    clocks = overlay.survival(memories, commits, shared)
    assert {r.node_id: r.survival for r in clocks.collect()} == {"p": 5, "q": 0, "w": 7, "s": 0, "n": 0}
    read = lambda at: {r.node_id: (r.usage, r.maturity) for r in overlay.overlay(memories, counters, clocks, at).collect()}
    assert read(6) == {"p": (4, "proposed"), "q": (4, "working"), "w": (9, "settled"), "s": (9, "working"), "n": (0, "working")}
    # later counters of w say less
    assert read(7)["w"] == (10, "working")


def test_events_without_a_session_do_not_meet(spark):
    from graphloom.operators import log

    rows = [("a", 1, None), ("b", 2, None), ("a", 3, 5), ("c", 4, 5), ("d", 5, None)]
    got = {r.id: r.survival for r in log.survival(spark.createDataFrame(rows, "id string, seq long, session long")).collect()}
    assert got == {"a": 4, "b": 3, "c": 1, "d": 0}

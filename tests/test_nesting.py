"""Nesting of spans against a search for the nearest one that holds another."""

import random

from graphloom.operators import nesting

SPANS = "file string, first long, last long, name string, kind string"


def _plain(rows):
    found = {}
    for file in {r[0] for r in rows if r[0]}:
        spans = {}
        for _, a, b, name, kind in sorted((r for r in rows if r[0] == file and r[1] is not None and r[1] <= r[2] and r[3]), key=lambda r: (r[3], r[4])):
            spans.setdefault((a, b), (name, kind))

        def qualified(span):
            holding = [s for s in spans if s != span and s[0] <= span[0] and span[1] <= s[1]]
            above = max(holding, key=lambda s: (s[0], -s[1]), default=None)
            return (f"{qualified(above)}." if above else "") + spans[span][0]

        for span in sorted(spans, key=lambda s: (s[0], -s[1])):
            name = qualified(span)
            found.setdefault((file, name), (*span, *spans[span]))
    return found


def test_nesting(spark):
    dice = random.Random(4)
    rows = [("a.rs", 1, 20, "Outer", "class"), ("a.rs", 2, 5, "run", "method"), ("a.rs", 7, 9, "run", "method"), ("a.rs", 3, 4, "inner", "function"), ("a.rs", 8, 8, "inner", "function"), ("a.rs", 30, 31, "run", "function"), ("a.rs", 2, 5, "alias", "method"), (None, 1, 2, "x", "y"), ("a.rs", 9, 1, "odd", "y"), ("a.rs", 1, 1, "", "y")]
    for f in ("b", "c"):
        for _ in range(80):
            a = dice.randrange(60)
            rows.append((f, a, a + dice.choice([0, 1, 3, 8, 20]), dice.choice("pqrst"), dice.choice(["m", "f"])))
    got = nesting.nest(spark.createDataFrame(rows, SPANS).repartition(4))
    assert {(r.file, r.qualname): (r.first, r.last, r.name, r.kind) for r in got.collect()} == _plain(rows)
    edges = {(r.src, r.dst) for r in nesting.contains(got.filter("file = 'a.rs'")).collect()}
    assert ("module:a.rs", "sym:a.rs#Outer") in edges and ("sym:a.rs#Outer", "sym:a.rs#Outer.alias") in edges and ("sym:a.rs#Outer.alias", "sym:a.rs#Outer.alias.inner") in edges
    assert nesting.nest(spark.createDataFrame([], SPANS)).count() == 0

"""Exchange over a shared log: convergence, refusals, tampering, repeats."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import exchange as X


def _said(i, parents=(), project=1, family="memory", actor="ann", **more):
    body = {"family": family, "attrs": {"label": i}, **more}
    import json

    return (project, i, list(parents), json.dumps(body), actor, "s1")


def frame(spark, rows):
    return spark.createDataFrame(rows, X.ASSERTION)


OWN = {
    "a": [_said("a1"), _said("a2", ["a1"]), _said("both"), _said("p", project=2)],
    "b": [_said("b1", actor="bob"), _said("b2", ["b1", "both"], actor="bob"), _said("both"), _said("both", actor="bob")],
}


def _rows(df):
    return sorted((r.project, r.id, r.actor, r.body, tuple(r.parents)) for r in df.collect())


@pytest.mark.parametrize("turns", ["ab", "ba"])
def test_workspaces_converge(spark, tmp_path, turns):
    remote = X.Log(spark, f"{tmp_path}/log")
    replicas = {w: X.Replica(spark, f"{tmp_path}/{w}") for w in "ab"}
    for w in turns:
        assert X.exchange(frame(spark, OWN[w]), replicas[w], remote).count() == 0
    for w in "ab":
        replicas[w].sync(remote)
    # the second workspace has "both" from the log already, so it does not send its own; all rows agree
    once = _rows(remote.events())
    assert {(r[0], r[1]) for r in once} == {(r[0], r[1]) for w in "ab" for r in OWN[w]}
    assert all(_rows(replicas[w].events()) == once for w in "ab")
    # parents come before what follows them, numbers have no gap, and an exchange without news changes nothing
    at = {r.id: r.seq for r in remote.events().collect()}
    assert at["a1"] < at["a2"] and at["b1"] < at["b2"] and at["both"] < at["b2"]
    assert sorted(r.seq for r in remote.events().filter("project = 1").collect()) == list(range(1, len([r for r in once if r[0] == 1]) + 1))
    before = remote.versions.committed()
    X.exchange(frame(spark, OWN["a"]), replicas["a"], remote)
    assert remote.versions.committed() == before and replicas["a"].sync(remote).count() == 0


def test_bad_assertions_are_refused_with_what_follows(spark, tmp_path):
    remote = X.Log(spark, f"{tmp_path}/log")
    bad = [
        _said("ok"), _said("n1", family=""), _said("n2", ["n1"]), _said("n3", ["n2", "ok"]), _said("d", attrs={"accepted": True, "label": "x"}), _said("e", edges=[{"relation": "tracks"}]),
        _said("f", edges=[{"relation": "tracks", "target": "t"}]), _said("lost", ["nowhere"]), _said("who", actor=""), _said("m", attrs=[1]),
    ]
    refused = {r.id: r.problems for r in remote.append(frame(spark, bad)).collect()}
    assert refused == {
        "n1": ["no family"], "n2": ["a refused parent"], "n3": ["a refused parent"], "d": ["derived attributes 'accepted'"], "e": ["an edge without relation or target"],
        "lost": ["unknown parents 'nowhere'"], "who": ["no actor"], "m": ["attributes are no mapping"],
    }
    assert {r.id for r in remote.events().collect()} == {"ok", "f"}
    # a parent that came with an earlier batch is known
    assert remote.append(frame(spark, [_said("later", ["ok"])])).count() == 0 and remote.events().count() == 3


class Tampered:
    """A log that changes what one project gets."""

    def __init__(self, log, change):
        self.log, self.change = log, change

    def head(self):
        return self.log.head()

    def pull(self, cursor):
        return self.change(self.log.pull(cursor))


CHANGES = {
    "body": lambda d: d.withColumn("body", F.when((F.col("project") == 1) & (F.col("id") == "a2"), "{}").otherwise(F.col("body"))),
    "dropped": lambda d: d.filter("project <> 1 or id <> 'a1'"),
    "cut": lambda d: d.filter("project <> 1 or seq < 3"),
    "nothing": lambda d: d.filter("project <> 1"),
}


@pytest.mark.parametrize("how", CHANGES)
def test_a_tampered_delta_moves_no_cursor(spark, tmp_path, how):
    remote = X.Log(spark, f"{tmp_path}/log")
    remote.append(frame(spark, OWN["a"]))
    replica = X.Replica(spark, f"{tmp_path}/a")
    assert {r.project: r.ok for r in replica.sync(Tampered(remote, CHANGES[how])).collect()} == {1: False, 2: True}
    assert {r.project for r in replica.cursor().collect()} == {2} and {r.id for r in replica.events().collect()} == {"p"}
    assert {r.project: (r.ok, r.pulled) for r in replica.sync(remote).collect()} == {1: (True, 3)}
    assert _rows(replica.events()) == _rows(remote.events())

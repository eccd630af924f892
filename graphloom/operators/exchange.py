"""Exchange of assertions between workspaces over a shared log, with tables in place of a service.

The shared log is the authority: it takes assertions that are well formed and whose parents it has, numbers them by project and chains them. A
workspace has its own assertions and a replica of the log with a cursor. It pulls what lies behind its cursor, works the chain out again, and commits events and
cursor together; then it sends what the replica does not have. Whatever the order in which workspaces exchange, all replicas come to hold the same events.

Assertions are (project, id, parents, body, actor, session); body is JSON with family, attrs and edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import assertions as A
from graphloom.operators import log
from graphloom.tables import materialize, settled
from graphloom.versions import Versions

ASSERTION = "project long, id string, parents array<string>, body string, actor string, session string"
EVENT = "project long, seq long, id string, parents array<string>, body string, actor string, session string, event_key string, prev_hash string, entry_hash string"
TAIL = "project long, seq long, entry_hash string"
#: What an event says beside its project and id.
_SAID = ["body", "parents", "actor", "session"]


def said(of: DataFrame) -> DataFrame:
    """of with payload, the text that its event key stands for; parents count as a set."""
    return of.withColumn("payload", F.to_json(F.struct("body", F.array_sort(F.array_distinct(F.coalesce("parents", F.array().cast("array<string>")))).alias("parents"), "actor", "session")))


def _key(of: DataFrame) -> Column:
    return log.event_key(F.col("project"), F.col("id"), F.col("payload"))


def _names(df: DataFrame) -> Column:
    return F.array_join(F.transform(F.array_sort(df), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def problems(batch: DataFrame, known: DataFrame) -> DataFrame:
    """project, id, problems (array, empty if all is well) of assertions that are to follow known (project, id).

    A body must have a family, attributes that are not a fold's to set, and edges with relation and target; there must be an actor and a session; every
    parent must be known or in the batch. An assertion whose parent is refused is refused too.
    """
    text = lambda path: F.get_json_object("body", path)
    leaked = F.array_intersect(F.coalesce(F.json_object_keys(text("$.attrs")), F.array().cast("array<string>")), F.array(*map(F.lit, A.DERIVED)))
    attrs, edges = text("$.attrs"), F.from_json(text("$.edges"), "array<struct<relation:string,target:string>>")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        F.when(F.coalesce(text("$.family"), F.lit("")) == "", "no family"),
        F.when(attrs.isNotNull() & ~F.startswith(attrs, F.lit("{")), "attributes are no mapping"),
        F.when(F.size(leaked) > 0, F.concat(F.lit("derived attributes "), _names(leaked))),
        F.when(text("$.edges").isNotNull() & (edges.isNull() | F.exists(edges, lambda e: e.isNull() | e["relation"].isNull() | e["target"].isNull())), "an edge without relation or target"),
        F.when(blank("actor"), "no actor"),
        F.when(blank("session"), "no session"),
    ]
    own = batch.select("project", "id", F.array_compact(F.array(*checks)).alias("own")).groupBy("project", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own"))
    asked = batch.select("project", "id", F.explode("parents").alias("parent")).distinct()
    there = known.select("project", F.col("id").alias("parent")).distinct()
    inside = batch.select("project", F.col("id").alias("parent")).distinct()
    open_ = materialize(asked.join(there, ["project", "parent"], "left_anti"))
    lost = open_.join(inside, ["project", "parent"], "left_anti").groupBy("project", "id").agg(F.collect_list("parent").alias("lost"))
    unknown = F.when(F.col("lost").isNotNull(), F.array(F.concat(F.lit("unknown parents "), _names(F.col("lost"))))).otherwise(F.array().cast("array<string>"))
    judged = materialize(own.join(lost, ["project", "id"], "left").select("project", "id", F.concat("own", unknown).alias("problems")))
    # what is refused takes along what follows it, a generation a round
    refused = judged.filter(F.size("problems") > 0).select("project", "id")
    fallen = None
    while True:
        follows = open_.join(refused.withColumnRenamed("id", "parent"), ["project", "parent"], "left_semi").select("project", "id").distinct()
        gone = judged.filter(F.size("problems") > 0).select("project", "id")
        new = follows.join(gone, ["project", "id"], "left_anti")
        refused = materialize(new if fallen is None else new.join(fallen, ["project", "id"], "left_anti"))
        if refused.isEmpty():
            break
        fallen = refused if fallen is None else fallen.unionByName(refused)
    if fallen is None:
        return judged
    marked = judged.join(fallen.withColumn("fell", F.lit(True)), ["project", "id"], "left")
    return marked.select("project", "id", F.when(F.col("fell"), F.array(F.lit("a refused parent"))).otherwise(F.col("problems")).alias("problems"))


class Log:
    """The shared log below a folder: events in committed versions that add up, and the chain's end of each project."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def events(self) -> DataFrame:
        held = [f"{self.versions.path}/{v}/events" for v in self.versions.committed()]
        return self.spark.read.schema(EVENT).parquet(*held) if held else self.spark.createDataFrame([], EVENT)

    def head(self) -> DataFrame:
        """project, seq, entry_hash of each project's last event."""
        last = self.versions.head()
        return self.versions.read(last[0], "tails") if last else self.spark.createDataFrame([], TAIL)

    def pull(self, cursor: DataFrame) -> DataFrame:
        """EVENTs behind a cursor (project, seq)."""
        return self.events().join(cursor.select("project", F.col("seq").alias("seen")), "project", "left").filter(F.col("seq") > F.coalesce("seen", F.lit(0))).drop("seen")

    def append(self, batch: DataFrame) -> DataFrame:
        """Takes ASSERTIONs in, each event once, and returns project, id, problems of those that it refuses. Parents get smaller numbers than what follows them."""
        held = self.events()
        judged = materialize(problems(batch, held))
        good = judged.filter(F.size("problems") == 0).select("project", "id")
        keyed = said(batch.join(good, ["project", "id"], "left_semi"))
        once = keyed.withColumn("event_key", _key(keyed)).dropDuplicates(["event_key"])
        fresh = materialize(once.join(held.select("event_key"), "event_key", "left_anti"))
        if not fresh.isEmpty():
            # ids of several projects are ordered together, under names that tell them apart
            name = lambda id_: F.concat_ws("\0", F.col("project").cast("string"), id_)
            place = A.causal_order(fresh.select(name(F.col("id")).alias("id"), F.transform("parents", name).alias("parents")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents")))
            ordered = fresh.withColumn("name", name(F.col("id"))).join(place.select(F.col("id").alias("name"), "place"), "name")
            tails = self.head()
            after = F.row_number().over(Window.partitionBy("project").orderBy("place", "event_key"))
            numbered = ordered.join(tails.select("project", F.col("seq").alias("last")), "project", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + after)
            numbered = materialize(numbered.select("project", "seq", "id", *_SAID, "payload"))
            chain = log.build_chain(numbered.select("project", "seq", "id", F.col("payload").alias("body")), tails).select("project", "seq", "event_key", "prev_hash", "entry_hash")
            new = materialize(numbered.join(chain, ["project", "seq"]).select(*(c.split()[0] for c in EVENT.split(", "))))
            ends = tails.unionByName(new.select("project", "seq", "entry_hash")).groupBy("project").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
            self.versions.write({"events": new, "tails": ends}, {}, prune=False)
        return judged.filter(F.size("problems") > 0)


def verify(delta: DataFrame, cursor: DataFrame, head: DataFrame) -> DataFrame:
    """project, ok, pulled of what was pulled (EVENT) for the projects of head: it must say what its keys stand for, go on from the cursor without a gap and end in the head."""
    told = said(delta)
    honest = told.withColumn("honest", _key(told) == F.col("event_key"))
    sound = log.verify_delta(honest, cursor)
    counts = honest.groupBy("project").agg(F.count("*").alias("pulled"), F.bool_and("honest").alias("honest"))
    ends = head.select("project", F.col("seq").alias("to"), F.col("entry_hash").alias("end"))
    met = ends.join(sound, "project", "left").join(counts, "project", "left").join(cursor.select("project", F.col("seq").alias("from")), "project", "left")
    whole = F.col("ok") & F.col("honest") & (F.col("head_seq") == F.col("to")) & (F.col("head_hash") == F.col("end")) & (F.col("pulled") == F.col("to") - F.coalesce("from", F.lit(0)))
    return met.select("project", F.coalesce(whole, F.lit(False)).alias("ok"), F.coalesce("pulled", F.lit(0)).alias("pulled"))


class Replica:
    """A workspace's copy of the shared log, and how far it has come."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    events = Log.events

    def cursor(self) -> DataFrame:
        last = self.versions.head()
        return self.versions.read(last[0], "tails") if last else self.spark.createDataFrame([], TAIL)

    def sync(self, remote: Log) -> DataFrame:
        """project, ok, pulled of the projects in which the log is ahead; none if the replica is current.

        Events and the cursor behind them are one commit. A project whose delta does not hold stays as it is, the others go on.
        """
        cursor = materialize(self.cursor())
        head = materialize(remote.head().join(cursor, ["project", "seq", "entry_hash"], "left_anti"))
        if head.isEmpty():
            return self.spark.createDataFrame([], "project long, ok boolean, pulled long")
        delta = materialize(remote.pull(cursor).join(head.select("project"), "project", "left_semi"))
        judged = settled(lambda: verify(delta, cursor, head))
        good = judged.filter("ok").select("project")
        if not good.isEmpty():
            moved = head.join(good, "project", "left_semi").select("project", "seq", "entry_hash")
            on = cursor.join(good, "project", "left_anti").unionByName(moved)
            self.versions.write({"events": delta.join(good, "project", "left_semi").select(*(c.split()[0] for c in EVENT.split(", "))), "tails": on}, {}, prune=False)
        return judged


def exchange(own: DataFrame, replica: Replica, remote: Log) -> DataFrame:
    """One exchange of a workspace's own ASSERTIONs; returns what the log refuses. What was not sent or not taken is in the next exchange again."""
    replica.sync(remote)
    known = replica.events().select("project", "id").distinct()
    refused = remote.append(own.join(known, ["project", "id"], "left_anti"))
    replica.sync(remote)
    return refused

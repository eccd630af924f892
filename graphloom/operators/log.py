"""Operators over the assertion log: (project, seq, id, session, actor, kind, body, ts)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.model import Graph

GENESIS = "0" * 64


def collapse(events: DataFrame) -> DataFrame:
    """One row of each id: the first body, and the distinct actors in the order of their first event."""
    per = events.groupBy("id", "actor").agg(F.min("seq").alias("seq"), F.count("*").alias("c"), F.min(F.struct("seq", "body")).alias("first"))
    return per.groupBy("id").agg(
        F.min("first").getField("body").alias("body"),
        F.min("seq").alias("first_seq"),
        F.sum("c").alias("events"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "actor"))), lambda x: x.actor.cast("string")), ",").alias("actors"),
    )


def first_by_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The event of least seq of each key: what an append that ignores known keys keeps."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def landings(events: DataFrame) -> DataFrame:
    """id, seq, actor of each id's first event."""
    return events.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by(F.coalesce(F.col("actor").cast("string"), F.lit("unattributed")), "seq").alias("actor"))


def own_actor(events: DataFrame, local: DataFrame) -> DataFrame:
    """The actor of the newest event whose id is local."""
    mine = events.join(local.select("id"), "id", "left_semi").filter(F.col("actor").isNotNull())
    return mine.agg(F.max_by(F.col("actor").cast("string"), "seq").alias("actor"))


def survival(events: DataFrame) -> DataFrame:
    """id, survival: events after the id's first one, less those of its own session. A null session is one of its own.

    Events after seq s are counted by blocks: a running count over block sizes and one inside each block, so no task orders the whole log.
    """
    block = F.floor(F.col("seq") / 65536)
    per = events.groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    after_block = per.select("b", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("beyond"))
    inside = Window.partitionBy("b").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    # events without a session count none of their own, so they need not meet
    own = Window.partitionBy("session", F.when(F.col("session").isNull(), F.xxhash64("seq"))).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = events.select("id", "seq", "session", block.alias("b")).withColumn("w", F.count("*").over(inside)).withColumn("o", F.when(F.col("session").isNull(), 0).otherwise(F.count("*").over(own)))
    each = ranked.join(after_block, "b").select("id", "seq", (F.col("w") + F.col("beyond") - F.col("o")).alias("survival"))
    return each.groupBy("id").agg(F.min_by("survival", "seq").alias("survival"))


def event_key(project: F.Column, id_: F.Column, body: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("\0", project.cast("string"), id_, body), 256)


def build_chain(events: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """project, seq, id, body, event_key, prev_hash, entry_hash along each project's events: entry = sha256(prev, 0 byte, key).

    tails (project, entry_hash) are the ends of chains that these events go on; projects without one begin at GENESIS. A project's events are
    read in order by one task, as the chain is serial by nature, which holds one hash at a time.
    """
    keyed = events.select("project", "seq", "id", "body", event_key(F.col("project"), F.col("id"), F.col("body")).alias("event_key"), F.lit(None).cast("string").alias("tail"))
    if tails is not None:
        kinds = {f.name: f.dataType for f in keyed.schema}
        first = tails.select("project", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("seq", "id", "body", "event_key")), F.col("entry_hash").alias("tail"))
        keyed = first.unionByName(keyed)
    ordered = keyed.repartition("project").sortWithinPartitions("project", F.desc_nulls_last("tail"), "seq", "id")

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, last = object(), GENESIS
        for batch in it:
            prev, entry = [], []
            for p, key, tail in zip(*(batch.column(c).to_pylist() for c in (0, 4, 5))):
                if p != project:
                    project, last = p, GENESIS
                if tail is not None:
                    last = tail
                    prev.append(None)
                    entry.append(None)
                    continue
                prev.append(last)
                last = hashlib.sha256(f"{last}\0{key}".encode()).hexdigest()
                entry.append(last)
            made = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(prev, pa.string()), pa.array(entry, pa.string())], names=[*batch.schema.names[:5], "prev_hash", "entry_hash"])
            yield made.filter(pa.array([x is not None for x in entry], pa.bool_()))

    kind = StructType([*keyed.schema.fields[:5], StructField("prev_hash", StringType()), StructField("entry_hash", StringType())])
    return ordered.mapInArrow(link, kind)


def verify_chain(chain: DataFrame) -> DataFrame:
    """project, bad, first_bad: entries that do not follow from the entry before them."""
    order = Window.partitionBy("project").orderBy("seq")
    prev = F.lag("entry_hash", 1, GENESIS).over(order)
    wrong = (F.col("prev_hash") != prev) | (F.col("entry_hash") != F.sha2(F.concat(prev, F.lit("\0"), F.col("event_key")), 256))
    return chain.select("project", "seq", wrong.alias("wrong")).groupBy("project").agg(F.count_if("wrong").alias("bad"), F.min(F.when(F.col("wrong"), F.col("seq"))).alias("first_bad"))


def pull(events: DataFrame, cursor: int) -> DataFrame:
    return events.filter(F.col("seq") > cursor)


def push_set(local: DataFrame, known: DataFrame) -> DataFrame:
    return local.join(known.select("id"), "id", "left_anti")


def ingest_problems(events: DataFrame) -> DataFrame:
    """seq and the problems of each event: no family, no actor, no session, unknown parent."""
    ids = events.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    joined = events.join(ids, "parent", "left")
    some = lambda cond, what: F.when(cond, what)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    found = F.array_compact(F.array(some(empty("family"), "no family"), some(empty("actor"), "no actor"), some(empty("session"), "no session"), some(F.col("parent").isNotNull() & F.col("known").isNull(), "unknown parent")))
    return joined.select("seq", F.array_join(found, "; ").alias("problems"))


def assign(conflicts: DataFrame, landed: DataFrame) -> DataFrame:
    """left_id, right_id, owner: who landed the later side owes the answer; the left one on a tie."""
    side = lambda k: landed.select(F.col("id").alias(k + "_id"), F.col("seq").alias(k + "_seq"), F.col("actor").alias(k + "_actor"))
    both = conflicts.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    later = F.coalesce("right_seq", F.lit(-1)) > F.coalesce("left_seq", F.lit(-1))
    return both.select("left_id", "right_id", F.coalesce(F.when(later, F.col("right_actor")).otherwise(F.col("left_actor")), F.lit("unattributed")).alias("owner"))


def owner_tally(owned: DataFrame) -> DataFrame:
    """owner, c: how many answers each owes."""
    return owned.groupBy("owner").agg(F.count("*").alias("c"))


def head_distance(ids: DataFrame, commits: DataFrame) -> DataFrame:
    """node_id, survival of ids (node_id, path): commits after the one that brought the path in, by commits (pos, path), pos 0 being the newest; 0 if unknown."""
    born = commits.groupBy("path").agg(F.max("pos").alias("pos"))
    return ids.join(born, "path", "left").select("node_id", F.coalesce("pos", F.lit(0)).cast("long").alias("survival"))


def verify_delta(delta: DataFrame, cursor: DataFrame) -> DataFrame:
    """project, ok, head_seq, head_hash of a pulled delta (project, seq, event_key, prev_hash, entry_hash) against cursors (project, seq, entry_hash).

    A delta is sound if its first entry follows from the cursor (or from GENESIS), every other one from the one before, and no seq is at or below the cursor's.
    """
    at = cursor.select("project", F.col("seq").alias("seen"), F.col("entry_hash").alias("held"))
    both = delta.join(at, "project", "left")
    order = Window.partitionBy("project").orderBy("seq")
    prev = F.coalesce(F.lag("entry_hash").over(order), "held", F.lit(GENESIS))
    good = (F.col("prev_hash") == prev) & (F.col("entry_hash") == F.sha2(F.concat(prev, F.lit("\0"), F.col("event_key")), 256)) & (F.col("seq") > F.coalesce("seen", F.lit(-1)))
    judged = both.select("project", "seq", "entry_hash", F.coalesce(good, F.lit(False)).alias("good"))
    return judged.groupBy("project").agg(F.bool_and("good").alias("ok"), F.max("seq").alias("head_seq"), F.max_by("entry_hash", "seq").alias("head_hash"))


def history(claims: DataFrame, live: DataFrame) -> DataFrame:
    """id: divergent claims (id, locator, actor, seq) all of which are older than the live revision of their locator and actor."""
    now = live.groupBy("locator", "actor").agg(F.max("seq").alias("live_seq"))
    judged = claims.join(now, ["locator", "actor"], "left").select("id", F.coalesce(F.col("seq") < F.col("live_seq"), F.lit(False)).alias("old"))
    return judged.groupBy("id").agg(F.bool_and("old").alias("old")).filter("old").select("id")


def rewrite_parents(assertions: DataFrame) -> DataFrame:
    """assertions (id, locator, parents, and others) with parents that are locators replaced by the ids of that locator's revisions; each parent once, in order."""
    at = assertions.select("id", F.posexplode("parents").alias("i", "parent"))
    revisions = assertions.filter("locator is not null").groupBy(F.col("locator").alias("parent")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    each = at.join(revisions, "parent", "left").select("id", F.struct("i", F.coalesce("ids", F.array("parent")).alias("ids")).alias("p"))
    per = each.groupBy("id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.ids))).alias("parents"))
    rest = assertions.drop("parents").join(per, "id", "left")
    return rest.select(*(F.coalesce("parents", F.array().cast("array<string>")).alias("parents") if c == "parents" else c for c in assertions.columns))


def fold(assertions: DataFrame, base: Graph | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and dangling edges of assertions (rank, id, locator, family, kind, label, edges array of (relation, target, pending)).

    A node is its locator or id; a later revision of a locator wins attribute by attribute. An edge resolves to nodes of no later rank, and to
    those of base, which are there from the start and lose to revisions.
    """
    named = assertions.withColumn("node_id", F.coalesce("locator", "id")).withColumn("rank", F.col("rank").cast("long"))
    cells = named.select("node_id", "family", "kind", "label", "rank")
    if base is not None:
        cells = cells.unionByName(base.nodes.select("node_id", "family", "kind", "label", F.lit(-1).cast("long").alias("rank")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    nodes = cells.groupBy("node_id").agg(last("family"), last("kind"), last("label"), F.max("rank").alias("last_rank"))
    out = named.select(F.col("node_id").alias("src"), "rank", F.explode("edges").alias("e")).select("src", "rank", F.col("e.relation").alias("relation"), F.col("e.target").alias("dst"), F.col("e.pending").alias("pending"))
    born = cells.groupBy(F.col("node_id").alias("dst")).agg(F.min("rank").alias("born"))
    known = out.join(born, "dst", "left")
    return nodes, known.filter("born <= rank").drop("born"), known.filter("born is null or born > rank").select("src", "relation", F.col("dst").alias("target"), "rank")


def project(edges: DataFrame, projections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with projections (rank, src, dst, relation, of) that no other relation of the pair shadows, and the shadowed ones.

    A projection is an edge that an assertion (of) draws between two other nodes. It is taken if its pair has no edge yet or one of the same relation;
    of several projections of a pair the first by rank decides.
    """
    held = edges.groupBy("src", "dst").agg(F.collect_set("relation").alias("held"))
    first = projections.groupBy("src", "dst").agg(F.min_by("relation", F.struct("rank", "relation")).alias("first"))
    both = projections.join(held, ["src", "dst"], "left").join(first, ["src", "dst"])
    free = F.when(F.col("held").isNull(), F.col("relation") == F.col("first")).otherwise(F.array_contains("held", F.col("relation")))
    judged = both.select("src", "dst", "relation", "of", "rank", free.alias("free"))
    new = judged.filter("free").select("src", "dst", "relation").distinct().join(edges.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")
    return edges.unionByName(new, allowMissingColumns=True), judged.filter("not free").select("src", "dst", "relation", "of")


def merge_telemetry(now: DataFrame, events: DataFrame) -> DataFrame:
    """node_id, usage, last_seen, upholds after new injections and upholds (node_id, ts, weight)."""
    added = events.groupBy("node_id").agg(F.count_if(F.col("weight").isNull()).alias("u"), F.max(F.when(F.col("weight").isNull(), F.col("ts"))).alias("l"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    both = now.join(added, "node_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("node_id", (zero("usage") + zero("u")).alias("usage"), F.greatest("last_seen", "l").alias("last_seen"), F.bround(zero("upholds") + zero("w"), 4).alias("upholds"))

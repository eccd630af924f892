"""Assertions: their merge, the order in which a fold takes them, and the fold itself.

An assertion has an id, its causal parents, a family, a locator (the node it revises; without one it is a node of its own), attributes, provenance, a scope
and edges. The order is the topological one that always takes the least id of those whose parents are all taken. It is found without one queue for
all: an assertion waits for the last of its parents, so the order is that of a forest, and in a forest of two branches the one with the smaller greatest
id comes first. Hence a key by which the order is a sort: along the path of last parents the ids that are greater than all after them, the greatest
first. Keys are compared element by element.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import log
from graphloom.operators.components import connected
from graphloom.tables import apart, discard, settled, small
from graphloom.tables import materialize as written

# Attributes that only a fold may set, and families whose truth is a file of the local workspace.
DERIVED = ["accepted", "superseded_in", "supersedes_out"]
FILE_FAMILIES = ["intent", "plan", "memory", "resolution"]
#: Columns that a merge keeps from the least body.
BODY = ["locator", "family", "attrs", "edges"]
#: Nodes of the largest component that one task orders with a queue.
QUEUE = 200_000


def materialize(df: DataFrame) -> DataFrame:
    """A written table that is not broadcast: a history's tables grow with it, and there are several a round."""
    return apart(written(df))


def merge(assertions: DataFrame) -> DataFrame:
    """One row of each id: parents, provenance and scope are the sorted unions of those of its rows, equal entries once.

    The rows of an id say the same, as ids come from contents; where they do not, the least body (all other columns) stands. So a merge of merges is
    the merge of all rows, in whatever order and split they come. Entries are made distinct map-side, before those of an id meet.
    """
    sets = [c for c in ("parents", "provenance", "scope") if c in assertions.columns]
    body = [c for c in assertions.columns if c not in ("id", *sets)]
    kinds = {c: assertions.schema[c].dataType.elementType for c in sets}
    empty = lambda which: [F.col("e").alias(c) if c == which else F.lit(None).cast(kinds[c]).alias(c) for c in sets]
    entries = None
    for c in sets:
        part = assertions.select("id", F.explode(c).alias("e")).select("id", F.lit(c).alias("of"), *empty(c))
        entries = part if entries is None else entries.unionByName(part)
    # maps cannot be compared, so the least body is found by a text of it; arrays that change with order are not in it
    said = assertions.groupBy("id").agg(F.min_by(F.struct(*body) if body else F.lit(None), F.to_json(F.struct(*body)) if body else F.lit("")).alias("b"))
    if entries is None:
        return said.select("id", *(F.col(f"b.{c}").alias(c) for c in body))
    each = entries.distinct().groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("of") == c, F.col(c)))).alias(c) for c in sets))
    both = said.join(each, "id", "left")
    filled = {c: F.coalesce(F.col(c), F.array().cast(assertions.schema[c].dataType)) for c in sets}
    return both.select("id", *(F.col(f"b.{c}").alias(c) for c in body), *(filled[c].alias(c) for c in sets)).select(*assertions.columns)


def _queue(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, id, parents), sorted by component and id, to (id, top, at, cyclic); one component is held at a time, small ones leave together."""

    def order(ids: list[str], parents: list[list[str]]) -> None:
        number = {x: i for i, x in enumerate(ids)}
        waits, after = [0] * len(ids), [[] for _ in ids]
        for i, above in enumerate(parents):
            for p in above:
                waits[i] += 1
                after[number[p]].append(i)
        ready = [i for i, n in enumerate(waits) if not n]
        top, at = [None] * len(ids), [0] * len(ids)
        most, count = -1, 0
        while ready:
            i = heapq.heappop(ready)
            most = max(most, i)
            top[i], at[i] = ids[most], count
            count += 1
            for j in after[i]:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, j)
        cyclic = [t is None for t in top]
        for column, values in zip(done, (ids, [t if t is not None else x for t, x in zip(top, ids)], at, cyclic)):
            column.extend(values)

    def flushed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=["id", "top", "at", "cyclic"])
        for column in done:
            column.clear()
        return out

    done: tuple[list, ...] = ([], [], [], [])
    now, ids, parents = None, [], []
    for batch in it:
        for component, id_, above in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if component != now and ids:
                order(ids, parents)
                ids, parents = [], []
                if len(done[0]) >= 10_000:
                    yield flushed()
            now = component
            ids.append(id_)
            parents.append(above or [])
    if ids:
        order(ids, parents)
    if done[0]:
        yield flushed()


def _then(key: Column, more: Column) -> Column:
    """The key of a path that goes on: what is greater than all that follows stays."""
    return F.when(F.size(more) == 0, key).otherwise(F.concat(F.filter(key, lambda x: x > F.get(more, 0)), more))


def _levels(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """id, key of the ids whose parents can all be taken, by sets of them that are ready together.

    Chains with one parent each are one step, by pointer doubling. The others take a round a level; a round reads what the last one made ready.
    """
    none = F.array().cast("array<string>")
    need = edge.groupBy("id").agg(F.count("*").alias("need"))
    single = materialize(edge.join(need.filter("need = 1").select("id"), "id").select("id", F.col("parent").alias("up"), F.array("id").alias("seg")))
    links, followed = single.count(), 1
    inner = single.select(F.col("id").alias("up"))
    while followed <= links and not single.join(inner, "up", "left_semi").isEmpty():
        above = single.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("seg").alias("before"))
        joined = single.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.when(F.col("next").isNull(), F.col("seg")).otherwise(_then(F.col("before"), F.col("seg"))).alias("seg"))
        single = materialize(joined)
        followed *= 2
    # those that still point into chains go round in circles
    chains = single.join(inner.distinct(), "up", "left_anti").select("id", "up", "seg")
    heads = ids.join(need, "id", "left").filter("need is null or need > 1")
    ends = materialize(chains.unionByName(heads.select("id", F.col("id").alias("up"), none.alias("seg"))))
    several = materialize(edge.join(heads.filter("need > 1").select("id"), "id", "left_semi").join(ends.withColumnRenamed("id", "parent"), "parent").select("id", "up", "seg"))
    ready = materialize(heads.filter("need is null").select("id", none.alias("key")).withColumn("key", F.array("id")))
    waiting = materialize(heads.filter("need > 1").select("id", "need", F.lit(0).cast("long").alias("got"), none.alias("best")))
    taken = [ready]
    while not ready.isEmpty():
        came = several.join(ready.withColumnRenamed("id", "up"), "up").select("id", _then(F.col("key"), F.col("seg")).alias("key")).groupBy("id").agg(F.count("*").alias("c"), F.max("key").alias("key"))
        now = materialize(
            waiting.join(came, "id", "left").select("id", "need", (F.col("got") + F.coalesce("c", F.lit(0))).alias("got"), F.when(F.col("key").isNull() | (F.col("best") > F.col("key")), F.col("best")).otherwise(F.col("key")).alias("best"))
        )
        ready = materialize(now.filter("got = need").select("id", _then(F.col("best"), F.array("id")).alias("key")))
        discard(waiting)
        waiting = now.filter("got < need")
        taken.append(ready)
    heads_key = taken[0]
    for part in taken[1:]:
        heads_key = heads_key.unionByName(part)
    return ends.join(heads_key.withColumnRenamed("id", "up"), "up").select("id", _then(F.col("key"), F.col("seg")).alias("key"))


def causal_order(assertions: DataFrame, most: int = QUEUE) -> DataFrame:
    """id, place (from 0), cyclic of every id: the order that always takes the least id of those whose known parents (id, parents) are all taken.

    Ids in a cycle or after one can never be taken; they come last, by id. Parents that are no id are passed over; rows of one id are merged; null
    parents are none; a null id is left out. A log of up to most ids is ordered by one queue, in one task. Of a larger one, components of up to most ids
    have a queue each, the others go level by level. Between
    components the greatest id taken so far decides. A key of a larger component holds the ids of its path that no later one exceeds,
    about the logarithm of the path's length where ids are hashes.
    """

    def make() -> DataFrame:
        ids = materialize(assertions.filter("id is not null").select("id").distinct())
        edge = materialize(assertions.filter("id is not null").select("id", F.explode("parents").alias("parent")).distinct().join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi"))
        above = edge.groupBy("id").agg(F.collect_list("parent").alias("parents"))
        queued_as = "id string, top string, at long, cyclic boolean"
        if small(ids, most):  # a log of that size needs no components: one queue is the order itself
            alone = ids.join(above, "id", "left").select(F.lit("").alias("component"), "id", "parents").repartition(1).sortWithinPartitions("id").mapInArrow(_queue, queued_as)
            last = F.max(F.when(~F.col("cyclic"), F.col("at"))).over(Window.partitionBy(F.lit(0)))
            flushed = F.coalesce(last, F.lit(-1)) + F.row_number().over(Window.partitionBy("cyclic").orderBy("id"))
            return alone.select("id", F.when(F.col("cyclic"), flushed).otherwise(F.col("at")).cast("long").alias("place"), "cyclic")
        none = F.array().cast("array<string>")
        roots = connected(edge.select(F.col("id").alias("a"), F.col("parent").alias("b")), few=False)
        every = materialize(ids.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("root").alias("component")))
        placed = every.filter("component is not null")
        # what has no other id before or after it needs no queue; its only parent can be itself
        lone = every.filter("component is null").join(above, "id", "left").select("id", F.col("id").alias("top"), none.alias("key"), F.lit(0).cast("long").alias("at"), F.col("parents").isNotNull().alias("cyclic"))
        large = materialize(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component"))
        small_ = placed.join(large, "component", "left_anti").join(above, "id", "left").select("component", "id", "parents")
        queued = small_.repartition("component").sortWithinPartitions("component", "id").mapInArrow(_queue, queued_as)
        keyed = lone.unionByName(queued.select("id", "top", none.alias("key"), "at", "cyclic"))
        if not large.isEmpty():
            hub = materialize(placed.join(large, "component", "left_semi").select("id"))
            level = _levels(materialize(edge.join(hub, "id", "left_semi")), hub)
            rest = hub.join(level, "id", "left").select("id", F.coalesce(F.get("key", 0), F.col("id")).alias("top"), F.coalesce("key", none).alias("key"), F.lit(0).cast("long").alias("at"), F.col("key").isNull().alias("cyclic"))
            keyed = keyed.unionByName(rest)
        return _numbered(keyed, ["cyclic", "top", "key", "at"], "place").select("id", "place", "cyclic")

    return settled(make)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row in order, from 0: a sort by ranges, and for each range the number of rows before it (a number a range)."""
    ranged = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r.p: r.c for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    # one row for each range of the sort
    start = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ranged.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


@dataclass(frozen=True)
class Folded:
    """nodes: node_id, family, attrs, provenance, scope, superseded_in, supersedes_out, accepted, born, last. edges: src, dst, relation, pending. dangling:
    src, relation, target, pending, rank. declined: the assertions that a deferral left out."""

    nodes: DataFrame
    edges: DataFrame
    dangling: DataFrame
    declined: DataFrame


def base_of(graph: Graph) -> Folded:
    """A graph as what a fold begins with: text columns of its nodes become attributes."""
    plain = [f.name for f in graph.nodes.schema if f.name not in ("node_id", "family") and f.dataType.simpleString() == "string"]
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in plain)), lambda x: x["value"].isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    zero = lambda n: F.lit(n).cast("long")
    nodes = graph.nodes.select("node_id", "family", F.map_from_entries(pairs).alias("attrs"), none("array<string>").alias("provenance"), none("array<string>").alias("scope"), zero(0).alias("superseded_in"), zero(0).alias("supersedes_out"), F.lit(True).alias("accepted"), zero(-1).alias("born"), zero(-1).alias("last"))
    lost = graph.dangling.select("src", "relation", "target", none("boolean").alias("pending"), zero(-1).alias("rank")) if graph.dangling is not None else None
    return Folded(nodes, graph.edges.select("src", "dst", "relation", "pending") if graph.edges is not None else None, lost, None)


def fold(assertions: DataFrame, base: Folded | None = None, defer: Iterable[str] = ()) -> Folded:
    """The graph of merged assertions, taken in causal order (or in the order of a column rank), on top of base.

    A node is a locator or an id. A later revision sets the family, provenance and scope, and the attributes that it names; others stay. An
    edge whose target is no node yet when it is drawn dangles. Of the edges of a pair the last decides the relation, and the last that says so
    whether it is pending. A supersede that is not pending counts for its target until the target is revised again, and for its source's last
    revision; a node is accepted while none counts. Attributes in DERIVED are never taken from an assertion.

    Families in defer give way to a node that is there already, in base or by an earlier assertion: such assertions are declined whole.
    """
    rank = assertions if "rank" in assertions.columns else assertions.join(apart(causal_order(assertions)).select("id", F.col("place").alias("rank")), "id")
    named = rank.withColumn("node_id", F.coalesce("locator", "id")).withColumn("rank", F.col("rank").cast("long"))
    held = base.nodes.select("node_id", F.lit(True).alias("held")) if base else None
    first = named.groupBy("node_id").agg(F.min("rank").alias("first"))
    known = first.join(held, "node_id", "left") if base else first.withColumn("held", F.lit(None).cast("boolean"))
    seen = named.join(known.select("node_id", "first", "held"), "node_id")
    late = F.coalesce(F.col("family").isin(list(defer)), F.lit(False)) & (F.coalesce("held", F.lit(False)) | (F.col("rank") > F.col("first")))
    judged = materialize(seen.withColumn("late", late).drop("first", "held"))
    taken, declined = judged.filter(~F.col("late")).drop("late"), judged.filter("late").drop("late", "node_id")

    last = taken.groupBy("node_id").agg(F.min("rank").alias("born"), F.max("rank").alias("last"), F.max_by(F.struct("family", "provenance", "scope"), "rank").alias("b"))
    own = last.select("node_id", "b.*", "born", "last", F.lit(0).cast("long").alias("was_in"), F.lit(0).cast("long").alias("was_out"))
    cells = taken.select("node_id", "rank", F.explode("attrs").alias("key", "value")).filter(~F.col("key").isin(DERIVED))
    if base:
        # of a node that is revised only the attributes remain, and that it was there from the start
        untouched = base.nodes.join(last.select("node_id"), "node_id", "left_anti")
        kinds = {f.name: f.dataType for f in own.schema}
        own = own.join(held, "node_id", "left").withColumn("born", F.when(F.col("held"), F.lit(-1).cast("long")).otherwise(F.col("born"))).drop("held")
        own = own.unionByName(untouched.select("node_id", "family", *(F.col(c).cast(kinds[c]).alias(c) if base.nodes.schema[c].dataType == kinds[c] else F.lit(None).cast(kinds[c]).alias(c) for c in ("provenance", "scope")), F.lit(-1).cast("long").alias("born"), F.lit(-1).cast("long").alias("last"), F.col("superseded_in").alias("was_in"), F.col("supersedes_out").alias("was_out")))
        cells = cells.unionByName(base.nodes.select("node_id", F.lit(-1).cast("long").alias("rank"), F.explode("attrs").alias("key", "value")))
    latest = cells.groupBy("node_id", "key").agg(F.max_by("value", "rank").alias("value"))
    attrs = latest.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    own = materialize(own)

    drawn = taken.select(F.col("node_id").alias("src"), "rank", F.posexplode("edges").alias("i", "e")).select("src", "rank", "i", "e.relation", F.col("e.target").alias("dst"), "e.pending")
    # counts by target: until it is revised again, so from its last revision on
    target = own.select(F.col("node_id").alias("dst"), F.col("born").alias("dst_born"), F.col("last").alias("dst_last"))
    met = materialize(drawn.join(target, "dst", "left"))
    found = met.filter("dst_born <= rank")
    counted = found.filter((F.col("relation") == "supersedes") & ~F.coalesce("pending", F.lit(False)))
    into = counted.filter("rank >= dst_last").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("more_in"))
    out = counted.groupBy(F.col("src").alias("node_id"), "rank").agg(F.count("*").alias("more_out"))
    sums = own.join(into, "node_id", "left").join(out.withColumnRenamed("rank", "last"), ["node_id", "last"], "left").join(attrs, "node_id", "left")
    superseded = F.col("was_in") + F.coalesce("more_in", F.lit(0))
    nodes = sums.select(
        "node_id", "family", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), "provenance", "scope", superseded.alias("superseded_in"), (F.col("was_out") + F.coalesce("more_out", F.lit(0))).alias("supersedes_out"), (superseded == 0).alias("accepted"), "born", "last"
    )
    every = found.select("src", "dst", "relation", "pending", F.struct("rank", "i").alias("at"))
    lost = met.filter("dst_born is null or dst_born > rank").select("src", "relation", F.col("dst").alias("target"), "pending", "rank")
    if base and base.edges is not None:
        every = every.unionByName(base.edges.select("src", "dst", "relation", "pending", F.struct(F.lit(-1).cast("long").alias("rank"), F.lit(0).alias("i")).alias("at")))
    if base and base.dangling is not None:
        lost = lost.unionByName(base.dangling.select(*lost.columns))
    edges = every.groupBy("src", "dst").agg(F.max_by("relation", "at").alias("relation"), F.max_by("pending", F.when(F.col("pending").isNotNull(), F.col("at"))).alias("pending"))
    return Folded(nodes, edges, lost, declined)


def replica_fold(local: Folded, replica: DataFrame, events: DataFrame, local_ids: DataFrame, families: Iterable[str] = FILE_FAMILIES) -> tuple[Folded, DataFrame]:
    """The local fold with the assertions of a synced replica on top, and the locators (locator) about which the two disagree.

    Nodes of families whose truth is a local file keep what the workspace says; the replica's copies are declined. A declined assertion is a
    disagreement unless the workspace authored the same id (local_ids), or every actor who claimed it in events (id, locator, actor, seq) has
    replaced it by a later revision that is live here. Nodes that only the replica has are folded as any other.
    """
    local_ids = local_ids.hint("merge")
    both = fold(replica, local, families)
    live = events.join(local_ids, "id", "left_semi")
    # a claim without a locator or an actor says nothing
    claims = events.join(local_ids, "id", "left_anti").filter("locator is not null and actor is not null")
    old = log.history(claims.select("id", "locator", "actor", "seq"), live.select("locator", "actor", "seq"))
    apart = both.declined.filter("locator is not null").join(local_ids, "id", "left_anti").join(old, "id", "left_anti")
    return both, apart.select("locator").distinct()

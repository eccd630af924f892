"""Prefix trie of conversations by smallest-member ownership.

A node is a sequence of first turns that a conversation begins with; the conversations that begin with it are its members, and its smallest member
owns it. What a conversation owns is a suffix of its path, since the members of a longer sequence are among those of a shorter one. So no tree
is walked: two group-bys find where each conversation's own part begins, windows along the paths mark it, and one group-by of
prefixes sums what the members bring and takes off what they own.

Turns are hashed before the first shuffle; texts are never moved. A node is known by its depth and 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import materialize, settled

NODE = ["depth", "n1", "n2"]
#: Ids that one piece of a node's list of ends joins.
PIECE = 8192


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), k1, k2, size of every turn; size is the text's code points.

    Null roles and texts are empty ones. Rows of one turn number are ordered by role, the text's first 32 characters and a hash; repeated rows are
    turns of their own. Rows without a conversation's id belong to none and are left out. Other columns are not read.
    """
    said = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    hashed = said.select(
        "conv_id", "turn", "role", F.substring("text", 1, 32).alias("begins"), F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"), F.length("text").cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "begins", "k1", "k2")
    return hashed.select("conv_id", F.row_number().over(order).alias("pos"), "k1", "k2", "size")


def rebuild(said: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Turns (part, pos, k1, k2, size) of every conversation c of said, rebuilt on the first of its span of ids.

    The first h turns come from conversation c - c % span, where h is crc32 of c's decimal digits modulo most; c's own turns after its first h follow.
    Part -1 is a row without a turn, which every conversation has.
    """
    convs = said.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = said.join(convs, "conv_id").filter("pos > h").select("conv_id", F.lit(1).alias("part"), "pos", "k1", "k2", "size")
    heads = said.filter((F.col("pos") < most) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(heads, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "k1", "k2", "size")
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), zero.alias("k1"), zero.alias("k2"), zero.alias("size")).unionByName(lent).unionByName(own)


def paths(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (p1, p2), size, rest (sizes from here to the end), last (the end's depth): a row for each node of each conversation's path."""
    along = Window.partitionBy("conv_id").orderBy("part", "pos")
    deep = rebuilt.withColumn("depth", (F.row_number().over(along) - 1).cast("long"))
    # each turn is hashed with its depth, so the exclusive or of a prefix tells the order of its turns too
    mixed = lambda k: F.bit_xor(F.when(F.col("depth") > 0, F.xxhash64("depth", k)).otherwise(F.lit(0).cast("long"))).over(along)
    named = deep.withColumn("n1", mixed("k1")).withColumn("n2", mixed("k2"))
    return named.select(
        "conv_id",
        *NODE,
        F.lag("n1").over(along).alias("p1"),
        F.lag("n2").over(along).alias("p2"),
        "size",
        F.sum("size").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        F.max("depth").over(Window.partitionBy("conv_id")).alias("last"),
    )


def nodes(path: DataFrame) -> DataFrame:
    """NODE, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of every node of written paths."""
    first = path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("last").alias("deepest"))
    # what a conversation owns begins at start; it ends in a leaf of its own if nobody goes on there
    own = first.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("start"), F.max(F.when(F.col("deepest") == F.col("depth"), 1).otherwise(0)).alias("leaf"))
    ahead = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    mine = F.col("start").isNotNull() & (F.col("depth") >= F.col("start"))
    marked = path.join(own, "conv_id", "left").withColumn("kept", F.coalesce(F.sum(F.when(mine, F.col("size"))).over(ahead), F.lit(0)))
    child = F.when((F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("last")), 1).otherwise(0)
    summed = materialize(
        marked.groupBy(*NODE).agg(
            F.min(F.struct("conv_id", "start")).alias("o"),
            F.min("p1").alias("p1"),
            F.min("p2").alias("p2"),
            F.count("*").alias("n_convs"),
            F.sum(child).alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
            # the members' occurrences of the subtree's turns, less one for each node; a node's own turn counts as well
            F.sum(F.col("rest") - F.col("kept")).alias("saved_tokens"),
        ).select(*NODE, "o.*", "p1", "p2", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    )
    shown = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    # inside its own part a conversation owns the parent too; only where the part begins someone else does
    inside = summed.filter("start < depth or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    above = summed.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    begins = summed.filter("start = depth and depth > 0").join(above, ["depth", "p1", "p2"])
    return inside.select(*shown).unionByName(begins.select(*shown))


def _pieces(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (NODE, conv_id) to (NODE, at, piece): runs of at most so many ids of a node, joined by commas."""
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("at", pa.int64()), ("piece", pa.string())])
    for batch in it:
        rows: list[tuple] = []
        held: list[int] = []
        now: tuple | None = None
        for *node, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if tuple(node) != now or len(held) == most:
                if held:
                    rows.append((*now, held[0], ",".join(map(str, held))))
                now, held = tuple(node), []
            held.append(conv)
        if held:
            rows.append((*now, held[0], ",".join(map(str, held))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (NODE, at, piece) to (NODE, ends_sha256); one hash in hand, however many pieces a node has."""
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    now, held = None, None
    for batch in it:
        rows = []
        for *node, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if tuple(node) == now:
                held.update(b"," + piece.encode())
                continue
            if now:
                rows.append((*now, held.hexdigest()))
            now, held = tuple(node), hashlib.sha256(piece.encode())
        if rows:
            yield pack(rows)
    if now:
        yield pack([(*now, held.hexdigest())])


def ends(path: DataFrame, piece: int = PIECE) -> DataFrame:
    """NODE, ends_sha256 of the nodes where conversations end: SHA-256 of their ids in order, joined by commas.

    A hash is serial, but only its bytes are: ids are sorted by range and joined into pieces by many tasks, and a node's pieces, a row for
    thousands of ids, pass one task with one hash in hand.
    """
    order = [*NODE, "conv_id"]
    sorted_ = path.filter("depth = last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ", ".join(f"{c} long" for c in [*NODE, "at"])
    pieces = sorted_.mapInArrow(lambda it: _pieces(it, piece), f"{kind}, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "at").mapInArrow(_digests, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def trie(rebuilt: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    n_leaves counts the subtree's childless nodes, saved_tokens sums (n_convs - 1) times the code points of the last text over the subtree; both
    include the node. ends_sha256 is the hash of the members that end there (of an empty string if none does). A table without conversations has no
    nodes, not even a root; a conversation without turns is a member of the root alone.
    """

    def make() -> DataFrame:
        path = materialize(paths(rebuilt))
        found = nodes(path).join(ends(path, piece), NODE, "left")
        return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

    return settled(make)

"""Reversible line dedup: exact reference counts per line key, sharded cuckoo filters over the frequent keys.

A key is the 128-bit hash of a line without blanks at its ends and with A-Z lowered. `reference_counts` counts the
documents of every key exactly; `add` inserts documents into or deletes them from such a table, so any insertion can be
undone. Keys found in enough documents go into cuckoo filters, one for each shard of the key space. `Store` holds both: it takes documents in and
out, and only the keys that thereby cross the limit are inserted into or deleted from the stored filter of their shard, which grows from the keys of its shard's counts.
A second pass over the texts drops lines that a filter holds, except keys on the exact list of the filters' false positives, which is read off
the reference counts. Filters and list are broadcast up to `broadcast_bytes`; beyond, the lines' keys go to the filters of their shards, and
only the keys that a filter holds are joined with the counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.llm.shared import discard, fresh, materialize

_BLANKS = b"\t\n\x0b\x0c\r "
#: Entries of a bucket, and places tried before a filter grows.
SLOTS, KICKS = 4, 200


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANKS).lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()):
        yield value.as_py() or b""


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints that supports deletion. Keys are 16-byte hashes; it grows when it is full."""

    def __init__(self, keys: list[bytes] = (), buckets: int = 0):
        self.size = buckets or max(1, 1 << max(0, (max(1, len(keys)) * 10 // (SLOTS * 8)).bit_length()))
        self.cells = np.zeros((self.size, SLOTS), np.uint16)
        self.keys: Counter[bytes] | None = Counter()
        for key in keys:
            self.insert(key)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = 1 + int.from_bytes(key[8:12], "little") % 65535
        a = int.from_bytes(key[:8], "little") % self.size
        return print_, a, self._other(a, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & (self.size - 1))

    def __contains__(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        return print_ in self.cells[a] or print_ in self.cells[b]

    def insert(self, key: bytes) -> None:
        self._known()
        self.keys[key] += 1
        if not self._put(key):
            held, self.size = list(self.keys.elements()), self.size * 2
            while True:
                self.cells = np.zeros((self.size, SLOTS), np.uint16)
                if all(self._put(k) for k in held):
                    break
                self.size *= 2

    def _known(self) -> None:
        if self.keys is None:
            raise ValueError("a filter restored without its keys can only be asked")

    def _put(self, key: bytes) -> bool:
        print_, a, b = self._places(key)
        at = a
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = print_
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            print_, self.cells[at, slot] = int(self.cells[at, slot]), print_
            at = self._other(at, print_)
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = print_
                return True
        return False

    def remove(self, key: bytes) -> bool:
        """Deletes one insertion of key; only keys that were inserted may be deleted."""
        self._known()
        print_, a, b = self._places(key)
        for bucket in (a, b):
            held = np.flatnonzero(self.cells[bucket] == print_)
            if len(held):
                self.cells[bucket, held[0]] = 0
                self.keys[key] -= 1
                if self.keys[key] <= 0:
                    del self.keys[key]
                return True
        return False

    def holds(self, heads: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Membership of many keys, as their first 8 bytes and bytes 8 to 12."""
        p = (1 + prints % 65535).astype(np.uint32)
        a = (heads % np.uint64(self.size)).astype(np.int64)
        b = a ^ ((p.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.size - 1)).astype(np.int64)
        p16 = p.astype(np.uint16)[:, None]
        return (self.cells[a] == p16).any(1) | (self.cells[b] == p16).any(1)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, keys: list[bytes] | None = None) -> Cuckoo:
        """A filter of to_bytes; it takes insertions and deletions if the keys it holds are given, as the counts table has them."""
        out = cls(buckets=max(1, len(raw) // (2 * SLOTS)))
        out.cells = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        out.keys = None if keys is None else Counter(keys)
        return out


#: Frequent keys of a shard, on the average: what one task holds when it builds a filter.
SHARD_KEYS = 1 << 19


def shards_for(keys: int) -> int:
    return max(16, min(1 << 16, -(-keys // SHARD_KEYS)))


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has at least min_chars code points; shorter ones are in no count and asked of no filter."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def reference_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """key (16 bytes), documents: in how many rows each line key of at least min_chars code points stands. A null text is one empty line."""

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts: dict[bytes, int] = {}
            for body in _texts(batch, "_text"):
                for key in {line_key(x) for x in body.split(b"\n")}:
                    if long_enough(key, min_chars):
                        counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([digest(k) for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "documents"])

    found = docs.select(F.col(text).alias("_text")).mapInArrow(keys, "key binary, documents long")
    return found.groupBy("key").agg(F.sum("documents").alias("documents"))


def add(counts: DataFrame, docs: DataFrame, sign: int = 1, text: str = "text", min_chars: int = 1) -> DataFrame:
    """The reference counts after inserting (1) or deleting (-1) documents; keys that no document has any more go."""
    delta = reference_counts(docs, text, min_chars).withColumn("documents", F.col("documents") * sign)
    return counts.unionByName(delta).groupBy("key").agg(F.sum("documents").alias("documents")).filter("documents > 0")


def _shard(key: str, shards: int) -> F.Column:
    return F.expr(f"cast(conv(hex(substring({key}, 13, 2)), 16, 10) as int) % {shards}")


def filters(counts: DataFrame, min_documents: int, shards: int) -> DataFrame:
    """shard, cells: a cuckoo filter for each shard of the keys found in at least min_documents documents."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([Cuckoo(table.column("key").to_pylist()).to_bytes()], pa.binary())})

    frequent = counts.filter(F.col("documents") >= min_documents).select("key", _shard("key", shards).alias("shard"))
    return frequent.groupBy("shard").applyInArrow(build, "shard int, cells binary")


@dataclass(frozen=True)
class Store:
    """counts (key, documents) of all line keys, and filters (shard, cells) of those that at least min_documents documents have, both written."""

    counts: DataFrame
    filters: DataFrame
    min_documents: int = 10
    min_chars: int = 1
    shards: int = 16

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text", min_documents: int = 10, min_chars: int = 1, shards: int | None = None) -> Store:
        counts = materialize(reference_counts(docs, text, min_chars))
        shards = shards or shards_for(counts.filter(F.col("documents") >= min_documents).count())
        return cls(counts, materialize(filters(counts, min_documents, shards)), min_documents, min_chars, shards)

    def insert(self, docs: DataFrame, text: str = "text") -> Store:
        return self._apply(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> Store:
        """Takes documents out that were inserted before."""
        return self._apply(docs, text, -1)

    def _apply(self, docs: DataFrame, text: str, sign: int) -> Store:
        """The store after a batch of documents; this one stays as it was. A shard's filter, its keys and the changes meet in one task: a filter's share of the keys."""
        delta = reference_counts(docs, text, self.min_chars).select("key", (F.col("documents") * sign).alias("change"))
        both = self.counts.join(delta, "key", "full_outer").select("key", F.coalesce("documents", F.lit(0)).alias("was"), (F.coalesce("documents", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("documents"))
        after = materialize(both)
        was, now = F.col("was") >= self.min_documents, F.col("documents") >= self.min_documents
        keys = after.filter(was | now).select(_shard("key", self.shards).alias("shard"), "key", was.alias("was"), now.alias("now"))
        changed = keys.join(keys.filter("was <> now").select("shard").distinct(), "shard", "left_semi")

        def turn(key: tuple[pa.Scalar, ...], stored: pa.Table, held: pa.Table) -> pa.Table:
            names, was, now = (held.column(c).to_pylist() for c in ("key", "was", "now"))
            if not held.num_rows:
                return stored.select(["shard", "cells"])
            one = Cuckoo.from_bytes(stored.column("cells")[0].as_py(), [k for k, x in zip(names, was) if x]) if stored.num_rows else Cuckoo()
            for k, x, y in zip(names, was, now):
                if x != y:
                    one.insert(k) if y else one.remove(k)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([one.to_bytes()], pa.binary())})

        stored = self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(turn, "shard int, cells binary")
        return replace(self, counts=after.filter("documents > 0").select("key", "documents"), filters=materialize(stored))


def _ask(held: dict[int, Cuckoo], keys: list[bytes], shards: int) -> np.ndarray:
    """Which keys the filters of their shards hold."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    heads = raw[:, :8].copy().view("<u8").ravel()
    prints = raw[:, 8:12].copy().view("<u4").ravel()
    shard = (raw[:, 12].astype(np.int64) * 256 + raw[:, 13]) % shards
    out = np.zeros(len(keys), bool)
    for s, one in held.items():
        at = np.flatnonzero(shard == s)
        if len(at):
            out[at] = one.holds(heads[at], prints[at])
    return out


def drop_lines(
    docs: DataFrame,
    counts: DataFrame | None = None,
    min_documents: int = 10,
    min_chars: int = 1,
    text: str = "text",
    shards: int | None = None,
    broadcast_bytes: int = 64 << 20,
    store: Store | None = None,
) -> DataFrame:
    """Drops the lines whose keys stand in at least min_documents documents, all of them in every document.

    Documents are counted among docs themselves, or taken as counted in counts, or in a store with its filters and its parameters. Keys of fewer
    than min_chars code points are not counted and their lines all stay. Filters have as many shards as their keys ask for, if no number is given.
    Returns the columns of docs, with the text of the lines that stay (joined by newlines; null and empty texts are one
    empty line and become empty), and n_lines, n_dropped, kept_sha256; input columns of these names are replaced, all other names are free.
    Documents are rows: repeated rows and null ids count one by one. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    made = {"n_lines", "n_dropped", "kept_sha256"}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in made))
    given = counts is not None or store is not None
    if store is not None:
        counts, min_documents, min_chars, shards = store.counts, store.min_documents, store.min_chars, store.shards
    else:
        counts = materialize(counts if given else reference_counts(docs, text, min_chars))
    frequent = counts.filter(F.col("documents") >= min_documents)
    many = frequent.count()
    shards = shards or shards_for(many)
    kept = store.filters if store is not None else filters(counts, min_documents, shards)
    #: A filter takes at most about 8 bytes a key: 2 bytes, at least 3/8 full after rounding up, and a doubling.
    if many * 8 > broadcast_bytes:
        return _sharded(docs, frequent, kept, text, shards, min_chars)
    built = {r.shard: Cuckoo.from_bytes(bytes(r.cells)) for r in kept.collect()}
    held = spark.sparkContext.broadcast(built)

    def errors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                keys = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, hit in zip(keys, _ask(held.value, keys, shards)) if hit], pa.binary())], ["key"])

    rare = counts.filter(F.col("documents") < min_documents).select("key")
    if given:  # the lines of docs may be missing from these counts
        rare = rare.unionByName(reference_counts(docs, text, min_chars).select("key").join(frequent.select("key"), "key", "left_anti")).distinct()
    wrong = rare.mapInArrow(errors, "key binary") if built else counts.limit(0).select("key")
    wrong = materialize(wrong)
    if wrong.count() * 64 > broadcast_bytes:
        return _sharded(docs, frequent, kept, text, shards, min_chars)
    excepted = spark.sparkContext.broadcast({bytes(r.key) for r in wrong.collect()})
    discard(wrong)
    if store is None:
        discard(counts)
    body = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))
    out = StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])
    arrow = to_arrow_schema(out)

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: dict[bytes, bool] = {}
            split = [x.split(b"\n") for x in _texts(batch, batch.schema.names[body])]
            keys = [[line_key(x) for x in lines] for lines in split]
            fresh_keys = list({k for ks in keys for k in ks if k and long_enough(k, min_chars)})
            if fresh_keys and built_any:
                found = [digest(k) for k in fresh_keys]
                seen = {k: True for k, d, hit in zip(fresh_keys, found, _ask(held.value, found, shards)) if hit and d not in excepted.value}
            kept = [b"\n".join([x for x, k in zip(lines, ks) if k not in seen]) for lines, ks in zip(split, keys)]
            dropped = [sum(k in seen for k in ks) for ks in keys]
            columns = list(batch.columns)
            columns[body] = pa.array(kept, pa.binary()).cast(arrow[body].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in split], pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], schema=arrow)

    built_any = bool(built)
    return docs.mapInArrow(rewrite, out)


#: A filter has so many copies, each for a part of the rows, so that a line of very many documents meets several tasks.
COPIES = 8


def _sharded(docs: DataFrame, frequent: DataFrame, stored: DataFrame, text: str, shards: int, min_chars: int) -> DataFrame:
    """The same for filters that are too large to broadcast: each task streams the keys of a shard's lines past that shard's filter."""
    row = fresh(docs, "_row")
    # a row's number must not change between the uses below, so it is written
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for n, body in zip(batch.column(0).to_pylist(), _texts(batch, "_text")):
                found = [digest(k) for k in {line_key(x) for x in body.split(b"\n")} if k and long_enough(k, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int64()), pa.array(found, pa.binary())], ["row", "key"])

    lines = numbered.select(F.col(row), F.col(text).alias("_text")).mapInArrow(keys, "row long, key binary")
    copy = F.pmod(F.xxhash64("row"), F.lit(COPIES)).cast("int")
    asked = lines.select(_shard("key", shards).alias("shard"), copy.alias("copy"), "row", "key", F.lit(None).cast("binary").alias("cells"))
    copies = stored.select("shard", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("key"), "cells")

    def pass_by(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in it:
            at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            rows, names, cells = (batch.column(c).to_pylist() for c in (2, 3, 4))
            lo = 0
            while lo < len(at):
                if cells[lo] is not None:
                    now, one = at[lo], Cuckoo.from_bytes(cells[lo])
                    lo += 1
                    continue
                hi = lo
                while hi < len(at) and at[hi] == at[lo] and cells[hi] is None:
                    hi += 1
                if at[lo] == now:
                    hit = np.flatnonzero(_ask({at[lo][0]: one}, names[lo:hi], shards))
                    yield pa.RecordBatch.from_arrays([pa.array([rows[lo + i] for i in hit], pa.int64()), pa.array([names[lo + i] for i in hit], pa.binary())], ["row", "key"])
                lo = hi

    together = asked.unionByName(copies).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.desc_nulls_last("cells"))
    # the filters' false positives go where only the keys they hold are compared
    hits = together.mapInArrow(pass_by, "row long, key binary").join(frequent.select("key"), "key", "left_semi")
    dropped = fresh(docs, "_drop")
    per = hits.groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(dropped))
    joined = numbered.join(per, row, "left").select(*docs.columns, dropped)
    out = StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])
    arrow = to_arrow_schema(out)
    body = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, sizes, gone = [], [], []
            for value, drop in zip(_texts(batch, batch.schema.names[body]), batch.column(batch.num_columns - 1).to_pylist()):
                every = value.split(b"\n")
                drop = set(drop or ())
                stay = [x for x in every if not drop or digest(line_key(x)) not in drop]
                texts.append(b"\n".join(stay))
                sizes.append(len(every))
                gone.append(len(every) - len(stay))
            columns = list(batch.columns[:-1])
            columns[body] = pa.array(texts, pa.binary()).cast(arrow[body].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], schema=arrow)

    return joined.mapInArrow(rewrite, out)

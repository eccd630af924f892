"""Exact n-gram Jaccard join in the metric space of shingle sets.

Texts of equal sets form a class. d(x, y) = 1 - |x & y| / |x | y| is a metric; two classes link when d <= 1 - t. Almost all
sets are at distance 1 of each other, so a set that is a pivot tells nothing about most others. Pivots of the first level are
therefore points with a single shingle: the cell of pivot s holds the sets nearest to s, those that have s as their
rarest shingle. By the triangle inequality a set within the radius of x misses at most n - ceil(t n) of x's n
shingles; this is the window in which x is copied into the cells of its next pivots, so every linked pair meets in some
cell. In a cell the set with the fewest rarer shingles is the pivot of the second level: all others are compared
with it, which joins groups of near copies with one comparison per member. Only cells that still hold sets of different components go on: small
ones compare the pairs across components, large ones are split again by the next pivot of each set.

Rarity comes from a sketch of counts over all texts (2**20 cells); it orders pivots only and cannot change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel
from graphloom.llm.shared import discard, fresh, materialize, release, settled, small, text_column
from graphloom.operators.components import connected

SKETCH_BITS, BLOCK_BITS = 20, 12
#: Levels of splitting at most; what is left then compares all pairs across components.
DEPTH = 4
#: A cell of m sets compares pairs while they are at most so many in all, and so many for each set.
LEAF_PAIRS, LEAF_EACH = 4096, 1024
#: 64-bit numbers of a set's parity bits. A bit says whether an odd number of the set's shingles falls on it, so two sets differ in
#: at least as many shingles as their bits differ: a bound that keeps most pairs of a leaf cell from leaving its join.
PARITY = 8
#: Ids of compared classes, and of rows that go, that are broadcast at most: numbers of 8 bytes.
ASKED, DROPPED = 1 << 20, 1 << 22
#: Cells of the filter that picks the texts whose sets are needed.
NEED_BITS = 21


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer than k words has the whole sequence as one."""
    found = kernel.words(kernel.LOWER[data], offsets, kernel.BLANK)
    hashes, _ = kernel.windows(found, k)
    out = []
    first = found.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            part = kernel.Words(found.starts[a:b], found.ends[a:b], found.hashes[a:b], found.rows[a:b], found.first)
            out.append(kernel.windows(part, b - a)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(s: np.ndarray, numbers: int = PARITY) -> np.ndarray:
    """So many numbers: bit b is set where an odd number of the hashes in s fall on b."""
    odd = np.bincount((s % np.uint64(64 * numbers)).astype(np.int64), minlength=64 * numbers) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(s: np.ndarray) -> np.ndarray:
    """Parity bits, a power of two and one at least for each hash, so that they tell long sets apart as well as short ones."""
    return parity(s, PARITY << max(0, int(np.ceil(np.log2(max(1, len(s)) / (64 * PARITY))))))


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Level of each cell: how many doublings its count is above the mean. 2**20 bytes."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in it:
            for _, _, data, offsets in kernel.slices(text_column(batch, "text")):
                hashes, whole = kernel.windows(kernel.words(kernel.LOWER[data], offsets, kernel.BLANK), k)
                cells += np.bincount((hashes[whole] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
        blocks = cells.reshape(-1, 1 << BLOCK_BITS)
        pick = np.flatnonzero(blocks.any(1))
        salt = np.random.default_rng().integers(0, 256)
        if len(pick):
            yield pa.RecordBatch.from_arrays([pa.array(pick.astype(np.int32)), pa.array(np.full(len(pick), salt, np.int32)), pa.array([blocks[i].tobytes() for i in pick], pa.binary())], ["block", "salt", "cells"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for chunk in table.column("cells"):
            raw = np.frombuffer(chunk.as_py(), np.uint32 if len(chunk.as_py()) == 4 << BLOCK_BITS else np.uint64)
            total += raw
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, salt int, cells binary"
    parts = docs.select("text").mapInArrow(count, kind)
    summed = parts.groupBy("block", "salt").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    cells = np.zeros(1 << SKETCH_BITS)
    for r in summed.collect():  # 256 blocks at most
        cells[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(bytes(r.cells), np.uint64)
    mean = max(1.0, float(cells.mean()))
    return np.floor(np.log2(np.maximum(1.0, cells / mean))).astype(np.uint8)


def _min_overlap(n, num: int, den: int):
    """Shingles that a set of n shares with a linked one at least."""
    return -(-num * n // den)


def _profiles(docs: DataFrame, levels: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """id, n, digest of the set (null for none), bits and wide: its parity, prefix: the rarest shingles, in order, that the window needs.

    A shingle stands in prefix as its level in the upper bits over 57 bits of its hash, so numbers compare as rarities do.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, offsets in kernel.slices(text_column(batch, "text")):
                sizes, digests, bits, wide, prefixes = [], [], [], [], []
                for s in sets_of(data, offsets, k):
                    n = len(s)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    bits.append(parity(s))
                    wide.append(wide_parity(s))
                    if n:
                        level = held.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                        ranked = np.sort((level << np.uint64(57)) | (s >> np.uint64(7)))
                        prefixes.append(ranked[: n - _min_overlap(n, num, den) + 1 + DEPTH].view(np.int64))
                    else:
                        prefixes.append(np.zeros(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)), pa.array(np.concatenate(parts))) for parts in (bits, wide, prefixes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], ["id", "n", "digest", "bits", "wide", "prefix"])

    return docs.mapInArrow(run, "id long, n long, digest binary, bits array<long>, wide array<long>, prefix array<long>")


def _need_cell(digest: bytes, doc: int | None) -> int:
    return xxhash.xxh3_64_intdigest(digest + str(doc).encode()) >> (64 - NEED_BITS)


def _needed_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """digest, shingles of the needed (digest, id) classes, from the texts. Marks of 2**21 cells keep most other texts out of the shuffle; what they let through besides does no harm."""

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array({_need_cell(d, i) for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}, pa.int32())], ["c"])

    marks = np.zeros(1 << NEED_BITS, bool)
    marks[needed.select("digest", "id").mapInArrow(cells, "c int").distinct().toArrow().column("c").to_numpy()] = True  # 2**21 at most
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task
        for batch in it:
            for lo, hi, data, offsets in kernel.slices(text_column(batch, "text")):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                made = []
                for s, i in zip(sets_of(data, offsets, k), ids):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if len(s) and digest not in seen and held.value[_need_cell(digest, i)]:
                        seen.add(digest)
                        made.append((digest, s))
                if made:
                    ends = np.append(0, np.cumsum([len(s) for _, s in made])).astype(np.int32)
                    flat = pa.array(np.concatenate([s for _, s in made]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["digest", "shingles"])

    return docs.mapInArrow(run, "digest binary, shingles array<long>").dropDuplicates(["digest"])


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.new: DataFrame | None = None
        self.known = docs.sparkSession.createDataFrame([], "node long, root long")
        self.tested: DataFrame | None = None

    def can_link(self, level: int):
        """Size and place filters on (n, pos) and (n2, pos2); level pivots before pos are known to be shared."""
        least = F.ceil((F.col("n") + F.col("n2")) * self.num / (self.num + self.den) - 1e-9)
        sizes = self.den * F.least("n", "n2") >= self.num * F.greatest("n", "n2")
        return sizes & (F.col("n") - F.col("pos") + level >= least) & (F.col("n2") - F.col("pos2") + level >= least)

    def differ_little(self):
        """On (n, bits) and (n2, bits2): linked sets differ in n + n2 - 2 * common shingles at most, and their bits in no more."""
        apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(PARITY)), F.lit(0))
        return apart * (self.num + self.den) <= (self.den - self.num) * (F.col("n") + F.col("n2"))

    def apart(self, wide, wide2):
        """How many of the bits of two sets differ, those of a set of twice as many folded once. Linked sets differ in size by less than two."""
        half = lambda x: F.shiftright(F.size(x), 1)
        fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda a, b: a.bitwiseXOR(b))
        even = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
        return F.aggregate(F.zip_with(even(wide, wide2), even(wide2, wide), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)

    def some_of(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Columns of the asked classes (cid). Ids of a checked number go to the classes; only more of them make the classes move."""
        return self.classes.select("cid", *columns).join(F.broadcast(asked) if small(asked, ASKED) else asked, "cid", "left_semi")

    def verify(self, pairs: DataFrame) -> None:
        """Compares pairs (a, b) exactly and adds the linked ones to links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        # the parity bits leave few pairs, so that only their sets' prefixes are moved
        asked = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        some = self.some_of(asked, "n", "wide").repartition("cid")
        light = lambda side, n, wide: some.select(F.col("cid").alias(side), F.col("n").alias(n), F.col("wide").alias(wide))
        both = pairs.join(light("a", "n", "wide"), "a").join(light("b", "n2", "wide2"), "b")
        few = (self.num + self.den) * self.apart(F.col("wide"), F.col("wide2")) <= (self.den - self.num) * (F.col("n") + F.col("n2"))
        # sets of sizes too far apart do not link, and their bits are of no like number
        sizes = self.den * F.least("n", "n2") >= self.num * F.greatest("n", "n2")
        # where linked sets may differ in size by more than two, bits would have to be folded more often: there all pairs go on
        close = materialize(both.filter(F.when(sizes, few if 2 * self.num >= self.den else F.lit(True)).otherwise(False)).select("a", "b"))
        near = materialize(self.bounded(close))
        discard(close)
        release(self.docs.sparkSession)
        if near.isEmpty():
            return
        wanted = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "cid")
        keys = materialize(self.some_of(materialize(wanted), "digest", "id"))
        found = materialize(_needed_sets(self.docs, keys, self.k))
        key = lambda side: keys.select(F.col("cid").alias(side), F.col("digest").alias(side + "d"))
        dealt = found.repartition("digest")  # one shuffle of the sets for both sides
        sets = lambda side: dealt.select(F.col("digest").alias(side + "d"), F.col("shingles").alias(side + "s"))
        joined = near.join(key("a"), "a").join(key("b"), "b").join(sets("a"), "ad").select("a", "b", "bd", "as").join(sets("b"), "bd")
        common = F.size(F.array_intersect("as", "bs")).cast("long")
        linked = joined.filter((self.num + self.den) * common >= self.num * (F.size("as") + F.size("bs"))).select("a", "b").distinct()
        linked = materialize(linked)
        discard(found)
        release(self.docs.sparkSession)
        if not linked.isEmpty():
            self.new = linked if self.new is None else self.new.union(linked)

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs that can still link by their prefixes alone: up to the rarity where the shorter prefix ends all common shingles are known, and
        beyond it there are at most as many as the set with fewer left."""
        asked = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        some = self.some_of(asked, "n", "prefix").repartition("cid")
        side = lambda k: some.select(F.col("cid").alias(k), F.col("n").alias("n" + k), F.col("prefix").alias("p" + k))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cut", F.least(F.element_at("pa", -1), F.element_at("pb", -1)))
        beyond = lambda k: F.col("n" + k) - F.size(F.filter("p" + k, lambda x: x <= F.col("cut")))
        most = F.size(F.array_intersect("pa", "pb")) + F.least(beyond("a"), beyond("b"))
        return both.filter((self.num + self.den) * most >= self.num * (F.col("na") + F.col("nb"))).select("a", "b")

    def region_pivots(self, entries: DataFrame, level: int) -> DataFrame:
        """Entries (region, cid, n, pos) with the pivot of their region (cid2, n2, pos2); lone sets go.

        The pivot is the set that has the fewest rarer shingles: what near copies were made from has none of its own, so most of them link with it.
        """
        same = F.ceil(F.col("n") * 2 * self.num / (self.num + self.den) - 1e-9)
        early = entries.filter(F.col("n") - F.col("pos") + level >= same)
        # place and size go as one number through the shuffle
        packed = F.shiftleft("pos", 32) + F.col("n")
        pivot = early.groupBy("region").agg(F.min(F.struct(packed.alias("np"), "cid")).alias("p")).select("region", F.col("p.np").alias("np2"), F.col("p.cid").alias("cid2"))
        both = entries.select("region", "cid", packed.alias("np")).join(pivot, "region").filter("cid != cid2")
        place, size = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
        return both.select("region", "cid", size("np").alias("n"), place("np").alias("pos"), "cid2", size("np2").alias("n2"), place("np2").alias("pos2"))

    def level(self, entries: DataFrame, level: int) -> DataFrame | None:
        """Joins the regions; returns the entries of the next level, or None."""
        members = materialize(self.region_pivots(entries, level))
        release(self.docs.sparkSession)
        self.verify(members.filter(self.can_link(level)).select(F.col("cid").alias("a"), F.col("cid2").alias("b")))
        roots = self.roots()
        home = lambda side, to: roots.select(F.col("node").alias(side), F.col("root").alias(to))
        labelled = members.join(home("cid", "r"), "cid", "left").join(home("cid2", "r2"), "cid2", "left")
        labelled = labelled.select("region", "cid", "n", "pos", F.coalesce("r", "cid").alias("root"), F.coalesce("r2", "cid2").alias("root2"))
        counts = labelled.groupBy("region", "root").agg(F.count("*").alias("c")).groupBy("region").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"))
        # all non-pivot members of one component, or only one: nothing to compare
        open_ = counts.filter(F.col("m") * F.col("m") > F.col("same")).select("region", ((F.col("m") * F.col("m") - F.col("same")) / 2 > LEAF_PAIRS + LEAF_EACH * F.col("m")).alias("large"))
        rest = materialize(labelled.drop("root2").join(open_, "region"))
        if rest.isEmpty():
            return None
        discard(members)
        last = level + 1 >= DEPTH
        # dealt out by region once for both sides of the join
        few = (rest if last else rest.filter(~F.col("large"))).join(self.classes.select("cid", "bits"), "cid").select("region", "cid", "n", "pos", "root", "bits").repartition("region")
        other = few.select("region", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"), F.col("bits").alias("bits2"))
        pairs = few.join(other, "region").filter((F.col("cid") < F.col("cid2")) & (F.col("root") != F.col("root2")) & self.can_link(level) & self.differ_little())
        self.verify(pairs.select(F.col("cid").alias("a"), F.col("cid2").alias("b")))
        if last:
            return None
        large = rest.filter("large").select("region", "cid", "n", "pos")
        if large.isEmpty():
            return None
        after = large.join(self.classes.select("cid", "prefix"), "cid")
        window = (F.col("n") - F.ceil(F.col("n") * self.num / self.den - 1e-9) + 1 + level + 1).cast("int")
        later = F.slice("prefix", (F.col("pos") + 2).cast("int"), F.greatest(F.lit(0), window - F.col("pos").cast("int") - 1))
        spread = after.select("region", "cid", "n", F.col("pos").alias("was"), F.posexplode(later).alias("step", "s"))
        return materialize(spread.select(F.xxhash64("region", "s").alias("region"), "cid", "n", (F.col("was") + F.col("step") + 1).alias("pos")))

    def roots(self) -> DataFrame:
        """node, root of all linked classes. Links that came since the last call are first drawn between the roots known then."""
        if self.new is None:
            return self.known
        of = lambda side: self.known.select(F.col("node").alias(side), F.col("root").alias(side + "r"))
        drawn = self.new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b")).filter("a <> b").distinct()
        found = materialize(connected(drawn))
        moved = self.known.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        added = found.join(self.known.select("node"), "node", "left_anti").select("node", "root")
        self.known, self.new = materialize(moved.unionByName(added)), None
        return self.known

    def run(self) -> DataFrame:
        levels = _sketch(self.docs, self.k)
        rows = materialize(_profiles(self.docs, levels, self.k, self.num, self.den))
        grouped = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
        self.classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()))
        narrow = materialize(rows.select("id", "n", "digest"))
        discard(rows)
        release(self.docs.sparkSession)
        window = (F.col("n") - F.ceil(F.col("n") * self.num / self.den - 1e-9) + 1).cast("int")
        entries: DataFrame | None = self.classes.select("cid", "n", F.posexplode(F.slice("prefix", 1, window)).alias("pos", "region")).select("region", "cid", "n", F.col("pos").cast("long").alias("pos"))
        level = 0
        while entries is not None:
            entries = self.level(entries, level)
            level += 1
        roots = self.roots()
        of_class = self.classes.select("cid", "digest", "id").join(roots, F.col("cid") == F.col("node"))
        least = of_class.groupBy("root").agg(F.min("id").alias("component"))
        merged = of_class.join(least, "root").select("digest", "component")
        alone = self.classes.select("digest", "id").join(merged, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"))
        out = narrow.join(alone, "digest", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """id, n_shingles, component_id of every row of docs: the least id that links reach.

    Two texts link when the Jaccard similarity of their sets of k-word shingles is at least num / den. Texts without words
    (null, empty) link with nothing and are their own component. Equal texts, also repeated rows, share a component. Rows
    with a null id take part; where a component has no other ids its id is null. An empty table gives an empty one.
    """
    num, den = similarity
    return settled(lambda: _Join(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), k, num, den).run())


def keep_one(docs: DataFrame, text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100), first_by: str = "doc_id") -> DataFrame:
    """docs with one row of each component, all columns; texts without words all stay."""
    row = fresh(docs, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = components(numbered, row, text, k, similarity)
    gone = materialize(found.filter("id <> component_id").select(F.col("id").alias(row)))
    # rows of a checked number go to the texts; only more of them make the texts move
    return numbered.join(F.broadcast(gone) if small(gone, DROPPED) else gone, row, "left_anti").drop(row)

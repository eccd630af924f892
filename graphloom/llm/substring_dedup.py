"""Substring dedup by content-defined chunks.

A gear hash over the last 32 bytes rolls over each text; a cut follows a byte where its top bits are zero and no other such byte
stands shortly before. Cuts depend on nearby bytes only, so an insertion moves no cut but those beside it. A stretch
that repeats a short unit has no such cuts of its own: it is cut from the unit's least rotation at fixed steps, and a chunk's number in the stretch
is part of its digest, so two stretches of one unit share as many chunks as the shorter one has. Chunks are
grouped by digest over all texts; a chunk repeats where its digest first stands in another document. Neighbouring repeated chunks join to
passages where the pair of them stands in an earlier document too, whatever documents their first places are in: pairs are counted like chunks.
Passages of enough words are the result, in pieces whose chunks stand in the same first document at the same distance. A passage begins and ends inside
chunks that are only partly its own: each chunk carries hashes of the bytes beside it (its wings), and a piece is extended by the longest wing that it has in
common with its first place (a wing has 16 bits, so one end in 65 536 is extended by chance, by 12 bytes).
The first pass only counts digests. The second keeps the chunks whose digests may repeat, by a filter of bounded size, and
joins them to the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import kernel
from graphloom.llm.shared import fresh, materialize, settled, text_column

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_NUMBERED = np.uint64(0x9E3779B97F4A7C15)
#: Bits that must be zero at a cut (one byte in 32), bytes without another cut before it, and the longest chunk.
CUT_BITS, QUIET, LONGEST = 5, 12, 256
#: Longest unit of a stretch that counts as periodic, shortest such stretch, and least bytes of its chunks.
PERIOD, STRETCH, STEP = 64, 72, 32
#: In a stretch longer than LONGEST a cut follows a byte whose hash is the least among so many bytes to each side.
AROUND = 32
#: Cells of the filter of repeated digests (8 MiB).
FILTER_BITS = 26


def periodic(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches of a slice that repeat a unit of at most PERIOD bytes, in order; the shortest period wins."""
    out: list[tuple[int, int, int]] = []
    taken = np.zeros(len(data), bool)
    for p in range(1, PERIOD + 1):
        n = (len(data) - p) // 8 * 8
        if n <= 0:
            break
        # eight bytes at a time; only places with enough equal ones in a row are looked at closely
        equal = np.flatnonzero(data[:n].view(np.uint64) == data[p : p + n].view(np.uint64))
        edges = np.flatnonzero(np.diff(equal, prepend=-2, append=len(data)) > 1)
        low, high = equal[edges[:-1]], equal[edges[1:] - 1] + 1
        enough = high - low >= max(1, (max(STRETCH - p, p) - 7) // 8)
        for lo, hi in zip(low[enough].tolist(), high[enough].tolist()):
            x, y = max(0, lo * 8 - 8), min(len(data), hi * 8 + p + 8)
            # rows part stretches
            rows = offsets[np.searchsorted(offsets, x, "right") : np.searchsorted(offsets, y, "left")].tolist()
            for left, right in zip([x, *rows], [*rows, y]):
                same = np.flatnonzero(np.diff(np.concatenate([[0], data[left : right - p] == data[left + p : right], [0]]))) if right - left > p else []
                for a, e in zip(same[::2], same[1::2]):
                    a, e = left + int(a), left + int(e) + p
                    if e - a >= max(STRETCH, 2 * p) and not taken[a + p : e - p].any():
                        taken[a:e] = True
                        out.append((a, e, p))
    return sorted(out)


def _gear(data: np.ndarray) -> np.ndarray:
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        moved = np.zeros_like(rolled)
        moved[step:] = rolled[:-step] << np.uint32(step)
        rolled = rolled + moved
    return rolled


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all chunks of a slice in order, each one's row and its number in a periodic stretch (from 1; 0 elsewhere); chunks do not cross rows."""
    rolled = _gear(data)
    zero = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0)
    quiet = np.ones(len(zero), bool)
    quiet[1:] = np.diff(zero) > QUIET
    # a text's first bytes see the text before it in the slice: they cut nothing
    row = np.searchsorted(offsets, zero, "right") - 1
    inner = zero[quiet & (zero - offsets[row] >= 32)] + 1
    inside = np.zeros(len(data) + 1, bool)
    begins, numbers = [], []
    for a, e, p in periodic(data, offsets):
        inside[a:e] = True
        unit = data[a : a + 2 * p].tobytes()
        step = p * -(-STEP // p)
        # what is left of the stretch after the last whole step is no chunk of it
        at = np.arange(a + min(range(p), key=lambda r: unit[r : r + p]), e + 1, step)
        begins.append(at)
        numbers.append(np.append(np.arange(1, len(at)), 0))
    inner = inner[~inside[inner]]
    starts = np.concatenate([inner, *begins, offsets[:-1][np.diff(offsets) > 0]])
    starts = np.unique(starts[starts < len(data)])
    lengths = np.diff(np.append(starts, len(data)))
    more = []
    for at, end in zip(starts[lengths > LONGEST].tolist(), (starts + lengths)[lengths > LONGEST].tolist()):
        # a text's first hashes see the text before it
        at = max(at, int(offsets[np.searchsorted(offsets, at, "right") - 1]) + 32)
        if end - at > 2 * AROUND:
            least = np.lib.stride_tricks.sliding_window_view(rolled[at:end], 2 * AROUND + 1).argmin(1) == AROUND
            more.append(at + AROUND + 1 + np.flatnonzero(least))
    starts = np.unique(np.concatenate([starts, *more]))
    lengths = np.diff(np.append(starts, len(data)))
    parts = -(-lengths // LONGEST)
    if len(starts) and parts.max() > 1:
        first = np.cumsum(parts) - parts
        within = np.arange(parts.sum()) - np.repeat(first, parts)
        starts = np.repeat(starts, parts) + within * LONGEST
    number = np.zeros(len(starts) + 1, np.int64)
    if begins:
        number[np.searchsorted(starts, np.concatenate(begins))] = np.concatenate(numbers)
    return starts, np.searchsorted(offsets, starts, "right") - 1, number[:-1]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start in the row, length, digest of each chunk."""
    starts, rows, number = cuts(data, offsets)
    ends = np.append(starts[1:], len(data))
    digests = kernel.Hasher(data).of(starts, ends)
    digests = np.where(number > 0, kernel.mix(digests + number.astype(np.uint64) * _NUMBERED), digests)
    return rows, starts - offsets[rows], ends - starts, digests.view(np.int64)


#: Bytes of the wings of a chunk, to each side; NO_WING marks those that would leave the text, another number for first places than for the others.
WINGS = (12, 24, 36, 48, 60, 72, 84, 96)
NO_WING = {"first": 1, "own": 2}
SIDES = ("l1", "l2", "r1", "r2")


def wings(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, none: int) -> list[np.ndarray]:
    """16-bit hashes of the WINGS before and after each chunk (starts within its row), four of them in each of four numbers."""
    hasher = kernel.Hasher(data)
    low, high = offsets[rows], offsets[rows + 1]
    a, b = low + starts, low + starts + sizes
    out = []
    for left in (True, False):
        found = []
        for k in WINGS:
            ok = a - k >= low if left else b + k <= high
            at = np.where(ok, a - k if left else b, low)
            h = hasher.of(at, np.where(ok, at + k, at)) >> np.uint64(48)
            found.append(np.where(ok, np.maximum(h, np.uint64(4)), np.uint64(none)))
        out += [sum(found[i + j] << np.uint64(16 * j) for j in range(4)).view(np.int64) for i in (0, 4)]
    return out


def wing_words(offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, word_starts: np.ndarray) -> list[np.ndarray]:
    """How many words begin in each of the WINGS before and after each chunk, eight bits for each."""
    a = offsets[rows] + starts
    b = a + sizes
    count = lambda x, y: np.searchsorted(word_starts, y) - np.searchsorted(word_starts, x)
    pack = lambda f: sum(np.minimum(f(k), 127).astype(np.int64) << (8 * i) for i, k in enumerate(WINGS))
    return [pack(lambda k: count(np.maximum(a - k, 0), a)), pack(lambda k: count(b, b + k))]


def _common(own: tuple[str, str], first: tuple[str, str]) -> F.Column:
    """How many of the WINGS of one side are equal, from the shortest on."""
    apart = lambda i: F.shiftright(F.col(own[i // 4]).bitwiseXOR(F.col(first[i // 4])), 16 * (i % 4)).bitwiseAND(F.lit(65535)) != 0
    return F.coalesce(*(F.when(apart(i), i) for i in range(8)), F.lit(8))


def pairs(rows: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks follow another one in their row, and the digest of each such pair."""
    second = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    d = digests.view(np.uint64)
    return second, kernel.mix(kernel.mix(d[second - 1]) * _NUMBERED + d[second]).view(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """digest, size, first (the least id and start) of the chunks and pairs of chunks that stand twice or more; equal ones of a batch go as one row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            for lo, _, data, offsets in kernel.slices(text_column(batch, "text")):
                rows, starts, sizes, digests = chunks(data, offsets)
                second, both = pairs(rows, digests)
                beside = [np.append(x, np.zeros(len(second), np.int64)) for x in wings(data, offsets, rows, starts, sizes, NO_WING["first"])]
                rows, starts, digests = np.append(rows, rows[second]), np.append(starts, starts[second]), np.append(digests, both)
                order = np.lexsort((starts, value[lo + rows], known[lo + rows], digests))
                new = np.ones(len(order), bool)
                new[1:] = np.diff(digests[order]) != 0
                pick = order[new]
                n = np.diff(np.append(np.flatnonzero(new), len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(digests[pick]), pa.array(n.astype(np.int64)), ids.take(pa.array(lo + rows[pick])), pa.array(starts[pick].astype(np.int64)), *(pa.array(x[pick]) for x in beside)], ["digest", "c", "id", "start", *SIDES])

    found = docs.mapInArrow(run, "digest long, c long, id long, start long, l1 long, l2 long, r1 long, r2 long")
    firsts = found.groupBy("digest").agg(F.sum("c").alias("c"), F.min(F.struct("id", "start", *SIDES)).alias("first")).filter("c > 1")
    return firsts.select("digest", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), *(F.col(f"first.{c}").alias("f" + c) for c in SIDES))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 30) -> DataFrame:
    """doc_id, start, end (bytes), n_words, first_doc_id, first_start of every passage that another document has before, a row for each of its pieces.

    Before means with a smaller id (null is smallest). A chunk's first place keeps its text; rows of one id are one document, so repeats within it
    (and repeated rows) are no passages. min_words counts the words of all pieces that begin in whole repeated chunks and the wings that extend them: what a passage
    has beyond its last common wing is not found, so 30 finds passages of over 50 words. Digests are 64-bit hashes: a false repeat would need several equal by chance in a row.
    Null and empty texts and empty tables have none.
    """
    return settled(lambda: _passages(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), min_words))


def _passages(source: DataFrame, min_words: int) -> DataFrame:
    repeated = materialize(_counts(source))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cell = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS))
            # bytes of the filter, eight cells each
            at, where = np.unique(cell >> np.uint64(3), return_inverse=True)
            bits = np.zeros(len(at), np.uint8)
            np.bitwise_or.at(bits, where, (1 << (cell & np.uint64(7))).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits.astype(np.int32))], ["at", "bits"])

    cells = repeated.select("digest").mapInArrow(mark, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**23 rows at most
    filter_ = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    filter_[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint8)
    held = source.sparkSession.sparkContext.broadcast(filter_)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, _, data, offsets in kernel.slices(text_column(batch, "text")):
                rows, starts, sizes, digests = chunks(data, offsets)
                second, both = pairs(rows, digests)
                found = kernel.words(data, offsets, kernel.BLANK)
                at = starts + offsets[rows]
                n = np.searchsorted(found.starts, at + sizes) - np.searchsorted(found.starts, at)
                beside = [*wings(data, offsets, rows, starts, sizes, NO_WING["own"]), *wing_words(offsets, rows, starts, sizes, found.starts)]
                body = kernel.Hasher(data).of(offsets[:-1], offsets[1:]).view(np.int64)
                # a pair goes as a row of its second chunk
                of = np.append(np.arange(len(rows)), second)
                asked = np.append(digests, both)
                cell = asked.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                keep = (held.value[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                of, pair = of[keep], np.arange(len(asked))[keep] >= len(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + rows[of])), *(pa.array(x[of].astype(np.int64)) for x in (body[rows], starts, sizes, n)), pa.array(pair), pa.array(asked[keep]), *(pa.array(np.where(pair, 0, x[of])) for x in beside)], ["id", "body", "start", "size", "n", "pair", "digest", *SIDES, "wl", "wr"])

    maybe = source.mapInArrow(ask, "id long, body long, start long, size long, n long, pair boolean, digest long, l1 long, l2 long, r1 long, r2 long, wl long, wr long")
    joined = maybe.join(repeated, "digest").filter(~F.col("id").eqNullSafe(F.col("first_id")))
    # one row of each chunk, also of repeated rows of one id and text
    reach = [_common(("l1", "l2"), ("fl1", "fl2")).alias("before"), _common(("r1", "r2"), ("fr1", "fr2")).alias("after")]
    place = F.when(~F.col("pair"), F.struct("first_id", (F.col("start") - F.col("first_start")).alias("shift"), *reach, "wl", "wr"))
    found = joined.groupBy("id", "body", "start", "size", "n").agg(F.min(place).alias("first"), F.bool_or("pair").alias("linked")).filter("first is not null").select("id", "body", "start", "size", "n", "first.*", "linked")
    inside = Window.partitionBy("id", "body").orderBy("start")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = F.coalesce(F.lag(F.col("start") + F.col("size")).over(inside) == F.col("start"), F.lit(False))
    alike = beside & F.lag("first_id").over(inside).eqNullSafe(F.col("first_id")) & (F.lag("shift").over(inside) == F.col("shift"))
    marked = found.withColumn("apart", (~(alike | beside & F.col("linked"))).cast("int")).withColumn("new", (~alike).cast("int"))
    runs = marked.withColumn("passage", F.sum("apart").over(so_far)).withColumn("piece", F.sum("new").over(so_far))
    bytes_of = lambda c: F.get(F.array(F.lit(0), *map(F.lit, WINGS)), c)
    words_of = lambda w, c: F.when(F.col(c) == 0, 0).otherwise(F.call_function("shiftright", F.col(w), (8 * (F.col(c) - 1)).cast("int")).bitwiseAND(F.lit(255)))
    first, last = (lambda v: F.min_by(v, "start")), (lambda v: F.max_by(v, "start"))
    spans = runs.groupBy("id", "body", "passage", "piece", "first_id", "shift").agg(
        (F.min("start") - first(bytes_of(F.col("before")))).alias("start"),
        (F.max(F.col("start") + F.col("size")) + last(bytes_of(F.col("after")))).alias("end"),
        (F.sum("n") + first(words_of("wl", "before")) + last(words_of("wr", "after"))).alias("n_words"),
    )
    long = spans.withColumn("all_words", F.sum("n_words").over(Window.partitionBy("id", "body", "passage"))).filter(F.col("all_words") >= min_words)
    return long.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("first_id").alias("first_doc_id"), (F.col("start") - F.col("shift")).alias("first_start")).distinct()


def remove(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the bytes of their passages; a cut inside a character takes the whole character. Null texts stay null."""
    key, found = fresh(docs, "_id"), fresh(docs, "_spans")
    per = spans.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found))
    joined = docs.join(per, F.col(doc_id).eqNullSafe(F.col(key)), "left").select(*docs.columns, found)
    body = next(i for i, c in enumerate(docs.columns) if c.lower() == text.lower())

    def cut(value: str | None, gone: list[dict] | None) -> str | None:
        if value is None or not gone:
            return value
        raw, out, at = value.encode(), [], 0
        for s in gone:
            out.append(raw[at : max(at, s["start"])])
            at = max(at, s["end"])
        return b"".join([x.decode(errors="ignore").encode() for x in [*out, raw[at:]]]).decode()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = list(batch.columns[:-1])
            columns[body] = pa.array([cut(v, g) for v, g in zip(columns[body].to_pylist(), batch.columns[-1].to_pylist())], columns[body].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(run, docs.schema)

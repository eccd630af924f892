"""Byte-level BPE encoding and decoding.

A batch of documents is split by the tokenizer's pattern into its distinct words. Spark higher-order functions fold the
ranked merges over each word's bytes; ranks come from a literal of one row, a table of rows laid into one flat array. Documents are put together
again from their words by higher-order functions too, so nothing goes back to Python. No shuffle takes part: a batch row holds
its distinct words once and each document as positions in them.

Ranks are a file of lines "base64 rank" (tiktoken's form); its path is a parameter.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import fresh, trim

#: A batch row ends at so many distinct words, or at so many bytes of texts, fewer where it carries texts or ids (a longer document is a row by itself).
BATCH_WORDS, BATCH_BYTES, CARRY_BYTES = 1 << 19, 32 << 20, 2 << 20
#: Ids are below NONE; a rank of NONE or above means no merge. END stands before the first and after the last byte of a word.
NONE, END = 1 << 16, 256
#: A word is an array with a number for each byte: the byte times WIDE, and the next one.
WIDE = 257
#: A piece is one number: the rank of its merge with the next piece, its place in the word (14 bits), its id (16 bits).
REST = (1 << 30) - 1
#: Words above this many bytes merge all places of the best pair in one step; shorter ones mark the places merged away as bits of one number, which has GONE set.
LONG_WORD, GONE = 60, 1 << 62
#: Steps of a turn of the fold.
STEPS = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that two neighbouring pieces merge to: every split of every token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def flat_table(merges: dict[tuple[int, int], int], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The merges as (offsets, cells): cells[offsets[a] + b] is a * NONE + rank for a pair (a, b), and begins with another id for any other pair.

    Each first id is a row of ranks; rows are laid over each other, longest first, each at the first of a series of offsets where no two ranks meet.
    Ids are 0 to top; top + 1 is an id without merges.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in merges.items():
        rows.setdefault(a, []).append((b, rank))
    width = max(1 << 14, 1 << (3 * len(merges)).bit_length() - 1)
    cells = np.full(width + top + 2, NONE - 1, np.int64) * NONE
    free = np.ones(len(cells), bool)
    offsets = np.zeros(top + 2, np.int64)
    block = 1 << 12
    rng = np.random.default_rng(1)
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        columns = np.array([b for b, _ in rows[a]])
        at = None
        for base in (rng.permutation(width // block) * block).tolist():
            fits = np.arange(base, base + block)
            for b in columns.tolist():
                fits = fits[free[fits + b]]
            if len(fits):
                at = int(fits[0])
                break
        if at is None:
            raise ValueError("the merges do not fit into the table")
        offsets[a] = at
        free[columns + at] = False
        cells[columns + at] = a * NONE + np.array([r for _, r in rows[a]])
    return offsets, cells


def pair_table(merges: dict[tuple[int, int], int], byte_ids: np.ndarray, end: int) -> np.ndarray:
    """The piece of a byte before another one, by byte * WIDE + next byte (END for the end of the word); its place is left 0."""
    out = np.zeros((WIDE, WIDE), np.int64)
    for x in range(WIDE):
        for y in range(WIDE):
            rank = merges.get((int(byte_ids[x]), int(byte_ids[y])), NONE) if END not in (x, y) else NONE
            out[x, y] = (rank << 30) + (end if x == END else int(byte_ids[x]))
    return out.ravel()


@lru_cache(4)
def tables(path: str) -> dict[str, list]:
    """The tables of a rank file: offsets, cells, pairs, each id's bytes and the id as little-endian unsigned 32-bit integer."""
    ranks = read_ranks(path)
    top = max(ranks.values())
    if top + 2 >= NONE:
        raise ValueError(f"ids must be below {NONE - 2}")
    merges = merge_table(ranks)
    offsets, cells = flat_table(merges, top)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
    pieces: list[bytes | None] = [None] * (top + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return {"offsets": offsets.tolist(), "cells": cells.tolist(), "pairs": pair_table(merges, byte_ids, top + 1).tolist(), "pieces": pieces, "codes": [i.to_bytes(4, "little") for i in range(top + 1)]}


def literal(spark: SparkSession, path: str) -> Column:
    """The tables of a rank file as one literal row. As a scalar subquery over that row it stays a few megabytes of flat numbers in every task;
    an array literal would be millions of objects."""
    arrays = {name: pa.array([values], pa.list_(pa.binary() if isinstance(values[-1], bytes) else pa.int64())) for name, values in tables(path).items()}
    return spark.createDataFrame(pa.table(arrays)).select(F.struct(*arrays)).scalar()


def _let(*values: Column, body: Callable[..., Column]) -> Column:
    """body(values), where each value is worked out once: the accumulator of a fold over nothing."""
    if not values:
        return body()
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, values[0], lambda a, _: a, lambda first: _let(*values[1:], body=lambda *rest: body(first, *rest)))


def _id(piece: Column) -> Column:
    return piece.bitwiseAND(F.lit(NONE - 1))


class Merges:
    """Column expressions of the merges, over the arrays of the literal."""

    def __init__(self, offsets: Column, cells: Column, pairs: Column):
        self.offsets, self.cells, self.pairs = offsets, cells, pairs

    def rank(self, a: Column, b: Column) -> Column:
        """The rank that ids a and b merge to, else NONE or more."""
        return F.get(self.cells, F.get(self.offsets, a) + b).bitwiseXOR(F.shiftleft(a, 16))

    def start(self, word: Column) -> Column:
        """The pieces of a word's bytes."""
        return F.transform(word, lambda b, i: F.get(self.pairs, b).bitwiseOR(F.shiftleft(i.cast("long"), 16)))

    def short(self, word: Column) -> Column:
        """Merges one place at a time: the least rank, the first such from the left. The least piece is thus the one to merge, and carries all that the step needs.

        The first number of the state has a bit for each place that is gone, so a piece's index follows from its place without a search.
        """
        bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place)
        place = lambda piece: F.shiftright(piece, 16).bitwiseAND(F.lit((1 << 14) - 1)).cast("int")

        def step(s: Column, least: Column) -> Column:
            low, gone = F.shiftright(least, 30), F.get(s, F.lit(0))

            here = place(least)

            def around(left: Column) -> Column:
                """Only the pieces at index left and beside it and the first number change; the piece after them goes."""
                before, at, after = F.get(s, left), left + 1, F.get(s, left + 2)
                changed = F.transform(
                    s,
                    lambda x, i: F.when((i < left) & (i > 0), x)
                    .when(i > at, x)
                    .when(i == at, F.shiftleft(self.rank(low, _id(F.get(s, left + 3))), 30).bitwiseOR(least.bitwiseAND(F.lit(REST - NONE + 1))).bitwiseOR(low))
                    .when(i == left, F.shiftleft(self.rank(_id(before), low), 30).bitwiseOR(before.bitwiseAND(F.lit(REST))))
                    .otherwise(gone.bitwiseOR(bit(place(after)))),
                )
                return F.array_remove(changed, after)

            return _let(here - F.bit_count(gone.bitwiseAND(bit(here) - 1)), body=around)

        def turn(s: Column, times: int) -> Column:
            """So many steps, or as many as there are: several at once leave fewer turns that find nothing."""
            again = lambda t: turn(t, times - 1) if times > 1 else t
            return _let(F.array_min(s), body=lambda least: F.when(least >= F.lit(NONE << 30), s).otherwise(_let(step(s, least), body=again)))

        # n bytes, n + 2 numbers, merge n - 1 times at most
        turns = F.sequence(F.lit(1), F.greatest(F.lit(1), ((F.size(word) + STEPS - 4) / STEPS).cast("int")))
        start = F.array_prepend(self.start(word), F.lit(GONE))
        return F.aggregate(turns, start, lambda s, _: turn(s, STEPS), lambda s: F.transform(F.slice(s, F.lit(3), F.size(s) - 3), _id))

    def long(self, word: Column) -> Column:
        """Merges all places of the best pair in a step, from the left, without overlaps. That equals one by one as long as no piece so made
        merges with a neighbour at a lower rank; where one does, only the first place is merged in this step.

        The state is p, the ids of the pieces, and r, the rank of each neighbouring pair (NONE or more where they do not merge).
        """

        def state(p: Column) -> Column:
            return F.struct(p.alias("p"), F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), self.rank).alias("r"))

        def step(s: Column, low: Column) -> Column:
            def merged(hit: Column) -> Column:
                was = lambda i: F.coalesce(F.get(hit, i), F.lit("0")) == "1"
                joined = F.transform(s.p, lambda x, i: F.when((i > 0) & was(i - 1), F.lit(None)).when(was(i), low).otherwise(x))
                return _let(F.filter(joined, lambda x: x.isNotNull()), body=state)

            flags = F.array_join(F.transform(s.r, lambda r: F.when(r == low, "1").otherwise("0")), "")
            lower = lambda i: (self.rank(low, F.get(s.p, i + 2)) < low) | ((i > 0) & (self.rank(F.get(s.p, i - 1), low) < low))
            unsafe = lambda hit: (self.rank(low, low) < low) | F.exists(F.transform(hit, lambda h, i: (h == "1") & lower(i)), lambda x: x)
            first = lambda hit: F.transform(hit, lambda h, i: F.when(i == F.array_position(hit, F.lit("1")) - 1, "1").otherwise("0"))
            places = _let(F.split(F.regexp_replace(flags, "11", "10"), ""), body=lambda hit: F.when(unsafe(hit), first(hit)).otherwise(hit))
            return _let(places, body=merged)

        start = _let(F.transform(word, lambda b: _id(F.get(self.pairs, b))), body=state)
        turn = lambda s, _: _let(F.array_min(s.r), body=lambda low: F.when(low >= NONE, s).otherwise(step(s, low)))
        return F.aggregate(word, start, turn, lambda s: F.slice(s.p, F.lit(2), F.size(s.p) - 2))

    def encode(self, word: Column) -> Column:
        """The ids of one word: array<long>."""
        return F.when(F.size(word) <= LONG_WORD + 2, self.short(word)).otherwise(self.long(word))


def joined(pieces: Column, ids: Column) -> Column:
    """The concatenation of the binary pieces of ids. array_join takes strings of raw bytes; as binary until then they are not copied."""
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)).cast("array<string>"), "").cast("binary")


def splitter(pattern: str):
    """text -> its matches of pattern. Texts of Latin-1 characters only go through the faster standard module, with classes spelled out."""
    import re

    import regex

    whole = regex.compile(pattern).findall
    # The letters, numbers and white space of Latin-1.
    letter, number, blank = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\t-\r \x85\xa0"
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")
    if r"\p" in plain:
        return whole
    latin = re.compile(plain).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return latin(text)

    return split


def _split(batches: Iterator[pa.RecordBatch], text: int, carry: list[int], pattern: str, rows: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    """Batch rows: the byte arrays of the distinct words between two ENDs, and each document's columns with its words' positions among them."""
    find = splitter(pattern)

    def row(kept: pa.RecordBatch, seen: dict[str, int], positions: list[np.ndarray]) -> pa.RecordBatch:
        coded = b"".join(w.encode() + b"\xff" for w in seen)  # no byte of UTF-8 is 255
        flat = np.frombuffer(coded, np.uint8)
        ends = np.flatnonzero(flat == 255)
        # an END after each word is one before the next: each word needs both
        lengths = np.diff(ends, prepend=-1) - 1
        starts = np.append(0, np.cumsum(lengths + 2))
        values = np.full(starts[-1], END, np.int32)
        inner = flat != 255
        values[np.flatnonzero(inner) + np.repeat(np.arange(len(ends)), lengths) + 1] = flat[inner]
        sizes = np.append(0, np.cumsum([len(p) for p in positions])).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(positions)))
        documents = pa.StructArray.from_arrays([*(c.cast(t.type) for c, t in zip(kept.columns, rows.value_type)), places], fields=list(rows.value_type))
        values[:-1] = values[:-1] * WIDE + values[1:]
        values[-1:] = END * WIDE + END
        words = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([one(words), one(documents).cast(rows)], ["words", "rows"])

    for batch in batches:
        kept = batch.select(carry)
        texts = batch.column(text)
        lo, held = 0, 0
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        positions: list[np.ndarray] = []
        for hi, value in enumerate(texts):
            body = value.as_py() or ""
            if hi > lo and (held + len(body) > most or len(seen) >= BATCH_WORDS):
                yield row(kept.slice(lo, hi - lo), seen, positions)
                lo, held, positions = hi, 0, []
                seen.clear()
            found = find(body)
            positions.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
            held += len(body)
        if positions:
            yield row(kept.slice(lo), seen, positions)
        del batch, kept, texts, positions
        trim()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns the columns named by carry (all by default) and n_tokens, ids_sha256 (of ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the bytes that the ids decode to) and, if asked for, ids; input columns of
    these names are replaced. A null text is an empty one and has no ids. Rows are independent: repeated rows give
    repeated results, an empty table gives an empty one; other columns may have any names. A batch row holds at most about BATCH_WORDS
    distinct words and BATCH_BYTES of texts (CARRY_BYTES where it takes string columns along or returns ids), or one document.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    at = next((i for i, c in enumerate(carry) if c.lower() == text.lower()), len(carry))
    source = docs.select(*carry, *([F.col(text).alias(fresh(docs, "_text"))] if at == len(carry) else []))
    fields = [StructField(f"c{i}", source.schema[i].dataType) for i in range(len(carry))]
    document = ArrayType(StructType([*fields, StructField("p", ArrayType(IntegerType()))]))
    arrow = to_arrow_type(document)
    wide = ids or any(isinstance(f.dataType, (StringType, BinaryType)) for f in fields)
    split = source.mapInArrow(
        lambda it: _split(it, at, list(range(len(carry))), pattern, arrow, CARRY_BYTES if wide else BATCH_BYTES),
        StructType([StructField("words", ArrayType(ArrayType(IntegerType()))), StructField("rows", document)]),
    )

    def documents(coded: Column, codes: Column, decoded: Column) -> Column:
        """One row for each document, from its words' ids, codes and decoded bytes."""

        def one(r: Column) -> Column:
            digest = lambda x: F.sha2(x, 256)
            return _let(
                joined(codes, r.p),
                body=lambda code: F.struct(
                    *(r[f.name].alias(f.name) for f in fields),
                    F.floor(F.octet_length(code) / 4).cast("long").alias("n_tokens"),
                    digest(code).alias("ids_sha256"),
                    digest(joined(decoded, r.p)).alias("decoded_sha256"),
                    *([F.flatten(F.transform(r.p, lambda i: F.get(coded, i))).cast("array<int>").alias("ids")] if ids else []),
                ),
            )

        return F.transform("rows", one)

    def coded(offsets: Column, cells: Column, pairs: Column, pieces: Column, codes: Column) -> Column:
        merges = Merges(offsets, cells, pairs)
        return _let(
            F.transform("words", merges.encode),
            body=lambda c: _let(F.transform(c, lambda x: joined(codes, x)), F.transform(c, lambda x: joined(pieces, x)), body=lambda code, decoded: documents(c, code, decoded)),
        )

    names = ("offsets", "cells", "pairs", "pieces", "codes")
    both = split.select("words", "rows", literal(docs.sparkSession, path).alias("tables"))
    out = both.select(F.inline(_let(*(F.col("tables")[n] for n in names), body=coded)))
    return out.select(*(F.col(f.name).alias(c) for f, c in zip(fields, carry)), *made)

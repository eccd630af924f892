"""Benchmark decontamination by template windows.

Tokens of texts and items are made canonical: numbers become <number>, units after a number <unit>, capitalised words inside a sentence
<name>; other words are lower-cased. Windows of k canonical tokens are hashed and joined to the items' windows, so a question
with other numbers or names still matches its template. A second reading keeps names as lower-cased words, so letter case alone does not part
a text from an item; a third one has an item's capitalised first word as <name>, as texts that embed the item in a sentence have it. The
fourth reading keeps all tokens as they are, so windows and items made mostly of placeholders are found where they stand word for word. A capitalised
word that opens a sentence may be a name or not: the last reading takes it as a <name> unless it is one of OPENERS. Each
matched window is then checked: its tokens must be equal in lower case or be placeholders of one kind. Along a passage every placeholder value
of the item must stand for one value of the text; two values of the item may become the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from graphloom.llm import kernel
from graphloom.llm.shared import batches, fresh, materialize, settled, text_column

# Unit words that may follow a number.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons
ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
percent dollar dollars cent cents euro euros degree degrees kph mph
""".split()
# Words that open sentences without being names.
OPENERS = """
a about above after all also although among an and another any are as at be because before being below between both but by calculate can choose compare
complete compute consider could define describe determine did discuss do does during each either estimate evaluate every explain express few fill find first
for from give given had has have he her here his how however i identify if in into is it its let list look make many may might more most must my name neither next no
nor not now of on one only or other our over place prove read second select several shall she should show simplify since sketch so solve some state such suppose
that the their then there therefore these they this those through thus to translate true under until use was we were what when where whether which
while who whom whose why will with would write yes you your
""".split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Window hashes of items that one scan of the texts holds; a larger benchmark is scanned for in blocks of this size.
BLOCK = 1 << 20

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n:;|")] = True


def _code(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return kernel.Hasher(data).of(np.array([0]), np.array([len(data)]))[0]


_UNIT_CODES = np.sort(np.array([_code(u) for u in UNITS], np.uint64))
_OPENER_CODES = np.sort(np.array([_code(u) for u in OPENERS], np.uint64))
_NUMBER, _UNIT, _NAME = (_code(x) for x in (NUMBER, UNIT, NAME))


def _lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case; where the bytes are no UTF-8, only A-Z are lowered."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    try:
        low = pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        return kernel.LOWER[data], offsets
    return next((d, o) for _, _, d, o in kernel.slices(low.cast(pa.large_binary()), 1 << 62))


class Tokens:
    """Canonical tokens of a slice: found (words in lower case), codes (hash of each canonical token), slot (0 word, 1 number, 2 unit, 3 name), open_slot
    (the same, with capitalised words that open a sentence as names, except OPENERS)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low, places = _lowered(data, offsets)
        self.found = kernel.words(self.low, places, kernel.PUNCTUATION)
        # lower case turns letters into letters, so the words of the text as it stands are the same ones, if at other bytes
        f = self.found if np.array_equal(places, offsets) else kernel.words(data, offsets, kernel.PUNCTUATION)
        hashes = self.found.hashes
        n = len(f.starts)
        self.capital = np.zeros(n, bool)
        self.slot = self.open_slot = np.zeros(n, np.int8)
        if n:
            digits = np.append(0, np.cumsum(_DIGIT[data]))
            number = digits[f.ends] - digits[f.starts] == f.ends - f.starts
            stops = np.append(0, np.cumsum(_STOP[data]))
            opens = np.ones(n, bool)
            opens[1:] = (f.rows[1:] != f.rows[:-1]) | (stops[f.starts[1:]] > stops[f.ends[:-1]])
            head = data[f.starts]
            second = data[np.minimum(f.starts + 1, len(data) - 1)]
            self.capital = capital = ((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            after = np.zeros(n, bool)
            after[1:] = number[:-1] & (f.rows[1:] == f.rows[:-1])
            at = np.minimum(np.searchsorted(_UNIT_CODES, hashes), len(_UNIT_CODES) - 1)
            unit = after & (_UNIT_CODES[at] == hashes)
            self.slot = np.select([number, unit, capital & ~opens], [1, 2, 3], 0).astype(np.int8)
            at = np.minimum(np.searchsorted(_OPENER_CODES, hashes), len(_OPENER_CODES) - 1)
            name = capital & ~(opens & (_OPENER_CODES[at] == hashes))
            self.open_slot = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        self.plain = np.select([self.slot == 1, self.slot == 2], [_NUMBER, _UNIT], hashes).astype(np.uint64)
        self.codes = np.where(self.slot == 3, _NAME, self.plain)

    def windows(self, k: int, item: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of windows of k tokens and which of them count, for each reading: within one text, in items with words in at least half of it or read as they are."""
        for codes, words, opening in self._readings(item):
            hashes, good = kernel.windows(self.found, k, codes)
            n = len(hashes)
            if item:
                literal = np.append(0, np.cumsum(words))
                good = good & (2 * (literal[k : k + n] - literal[:n]) >= k)
            yield hashes, good if opening is None else good & opening[:n]

    def _readings(self, item: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Codes, which tokens are words, and which windows are read so (None for all)."""
        yield self.codes, self.slot == 0, None
        yield self.plain, (self.slot == 0) | (self.slot == 3), None
        yield self.found.hashes, np.ones(len(self.codes), bool), None
        yield np.where(self.open_slot == 3, _NAME, self.plain), self.open_slot == 0, None
        if item:
            opening = np.zeros(len(self.codes), bool)
            first = self.found.first[:-1]
            opening[first[first < len(opening)]] = True
            opening &= self.capital
            yield np.where(opening, _NAME, self.codes), self.slot == 0, opening

    def strings(self, at: int, k: int) -> list[str]:
        """k tokens from at: words as they are, slots as their sign and value."""
        out = []
        for j in range(at, at + k):
            word = bytes(self.low[self.found.starts[j] : self.found.ends[j]]).decode(errors="replace")
            out.append(word if not self.open_slot[j] else f"{(NUMBER, UNIT, NAME)[self.open_slot[j] - 1]}{word}")
        return out


def _rows(texts: pa.Array, ids: list, k: int, wanted: dict[int, np.ndarray] | None) -> Iterator[tuple]:
    """(id, text key, tokens in all, window size, first token, hash, tokens) of the wanted windows of each text."""
    for lo, hi, data, offsets in kernel.slices(texts):
        tokens = Tokens(data, offsets)
        first = tokens.found.first
        sizes = np.diff(first)
        for size in sorted(wanted) if wanted is not None else range(1, k + 1):
            read: list[np.ndarray] = []
            for hashes, good in tokens.windows(size, wanted is None):
                for other in read:  # a window without names is the same in two readings
                    good = good & (hashes != other)
                read.append(hashes)
                if wanted is None:
                    # a short item is one window of its own
                    good &= (sizes[tokens.found.rows[: len(good)]] == size) if size < k else (sizes[tokens.found.rows[: len(good)]] >= k)
                else:
                    at = np.minimum(np.searchsorted(wanted[size], hashes), len(wanted[size]) - 1)
                    good &= wanted[size][at] == hashes
                for p in np.flatnonzero(good).tolist():
                    row = int(tokens.found.rows[p])
                    key = xxhash.xxh3_128_digest(data[offsets[row] : offsets[row + 1]].tobytes())
                    yield ids[lo + row], key, int(sizes[row]), size, p - int(first[row]), int(hashes[p].view(np.int64)), tokens.strings(p, size)


_KIND = "id long, key binary, n long, size int, pos long, h long, tokens array<string>"
_ARROW = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("size", pa.int32()), ("pos", pa.int64()), ("h", pa.int64()), ("tokens", pa.list_(pa.string()))])

_FOUND = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("item", pa.int64()), ("item_n", pa.int64()), ("d", pa.int64()), ("n_tokens", pa.int64()), ("q", pa.int64()), ("slots", pa.int32())])


def _passage(matched: list[tuple[int, str, str]]) -> Iterator[tuple[int, int, int]]:
    """(tokens, first item position, slots) of passages among the matched (item position, item token, text token) of a diagonal, in order.

    All of it if its slots are consistent; else each run of neighbouring tokens whose slots are, and in the other runs each stretch of equal tokens.
    """

    def slots(part: list[tuple[int, str, str]]) -> set[tuple[str, str]]:
        return {(v, u.rpartition(">")[2]) for _, v, u in part if v.startswith("<")}

    def split(part: list[tuple[int, str, str]]) -> Iterator[list[tuple[int, str, str]]]:
        first = 0
        for j in range(1, len(part) + 1):
            if j == len(part) or part[j][0] != part[j - 1][0] + 1:
                yield part[first:j]
                first = j

    def whole(part: list[tuple[int, str, str]]) -> bool:
        pairs = slots(part)
        return len({v for v, _ in pairs}) == len(pairs)

    if whole(matched):
        yield len(matched), matched[0][0], len(slots(matched))
        return
    for run in split(matched):
        equal = [m for m in run if m[1].rpartition(">")[2] == m[2].rpartition(">")[2]]
        for part in [run] if whole(run) else split(equal) if equal else []:
            yield len(part), part[0][0], len(slots(part))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 8, min_tokens: int = 13) -> DataFrame:
    """doc_id, item_id, n_tokens, item_tokens, n_slots, first_token of every text that holds a passage of an item.

    A passage is the matched windows of one diagonal (text position less item position) if their slots are consistent, or else a run of them with
    consistent slots, or a stretch of equal tokens; it counts when it has at least min_tokens tokens of the item, or all of a shorter item. Items of fewer than k tokens are one window; items of fewer than 3 tokens
    are not looked for, those of more placeholders than words only word for word. For a text and item the longest passage is returned. Rows of one id and text are
    one document. Null and empty texts and empty tables have no leaks; a null id is an id.
    """
    source = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return settled(lambda: _leaks(source(docs, doc_id), source(items, item_id), k, min_tokens))


def _leaks(docs: DataFrame, items: DataFrame, k: int, min_tokens: int) -> DataFrame:
    spark = docs.sparkSession

    def item_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches(_rows(text_column(batch, "text"), batch.column(0).to_pylist(), k, None), _ARROW)

    templates = materialize(items.mapInArrow(item_windows, _KIND).filter(f"size >= {min(3, k)}"))
    distinct = templates.select("size", "h").distinct()
    blocks = -(-distinct.count() // BLOCK)
    hits: DataFrame | None = None
    for b in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).toArrow()
        sizes, hashes = part.column("size").to_numpy(), part.column("h").to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast({int(s): np.sort(hashes[sizes == s]) for s in np.unique(sizes)})

        def text_windows(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in it:
                yield from batches(_rows(text_column(batch, "text"), batch.column(0).to_pylist(), k, held.value), _ARROW)

        more = docs.mapInArrow(text_windows, _KIND)
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        hits = spark.createDataFrame([], _KIND)
    other = templates.select("size", "h", F.col("id").alias("item"), F.col("key").alias("item_key"), F.col("n").alias("item_n"), F.col("pos").alias("item_pos"), F.col("tokens").alias("item_tokens"))
    slot = lambda t: t.startswith("<")
    sign = lambda t: F.substring_index(t, ">", 1)
    value = lambda t: F.substring_index(t, ">", -1)
    same = F.forall(F.zip_with("tokens", "item_tokens", lambda a, b: (value(a) == value(b)) | (slot(a) & slot(b) & (sign(a) == sign(b)))), lambda x: x)
    matched = hits.join(other, ["size", "h"]).filter(same).withColumn("d", F.col("pos") - F.col("item_pos"))
    # (item position, item token, text token) of each matched token on the diagonal
    pairs = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("item_pos") + i).alias("q"), F.get("item_tokens", i).alias("v"), F.get("tokens", i).alias("u")))
    per = matched.groupBy("id", "key", "item", "item_key", "item_n", "d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("m"))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = batch.to_pylist()
            yield from batches(((r["id"], r["key"], r["item"], r["item_n"], r["d"], *p) for r in rows for p in _passage([(x["q"], x["v"], x["u"]) for x in r["m"]])), _FOUND)

    found = per.mapInArrow(judge, "id long, key binary, item long, item_n long, d long, n_tokens long, q long, slots int").filter(F.col("n_tokens") >= F.least(F.lit(min_tokens), F.col("item_n")))
    best = found.groupBy("id", "key", "item", "item_n").agg(F.max(F.struct("n_tokens", (-(F.col("d") + F.col("q"))).alias("at"), "slots")).alias("b"))
    return best.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "b.n_tokens", F.col("item_n").alias("item_tokens"), F.col("b.slots").alias("n_slots"), (-F.col("b.at")).alias("first_token"), "key")


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 8, min_tokens: int = 13, broadcast_rows: int = 500_000) -> DataFrame:
    """docs without the rows that leak; the leaking (id, text hash) pairs are broadcast up to broadcast_rows, else joined by a shuffle."""
    bad = materialize(leaks(docs, items, doc_id, item_id, text, k, min_tokens).select(F.col("doc_id").alias("_bad"), "key").distinct())
    if bad.count() > broadcast_rows:
        key = fresh(docs, "_key")
        names = [*docs.columns, key]
        at = next(i for i, c in enumerate(names) if c.lower() == text.lower())

        def with_key(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                digests = [xxhash.xxh3_128_digest(t.as_py().encode()) for t in batch.column(at).fill_null("")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=names)

        keyed = docs.mapInArrow(with_key, StructType([*docs.schema, StructField(key, BinaryType())]))
        other = bad.select(F.col("_bad").alias(fresh(keyed, "_bad")), F.col("key").alias(fresh(keyed, "_other")))
        return keyed.join(other, F.col(doc_id).eqNullSafe(F.col(other.columns[0])) & (F.col(key) == F.col(other.columns[1])), "left_anti").drop(key)
    held = docs.sparkSession.sparkContext.broadcast({(r[0], bytes(r[1])) for r in bad.collect()})
    names = [c.lower() for c in docs.columns]
    ids, body = names.index(doc_id.lower()), names.index(text.lower())

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(body).fill_null("")
            known = {i for i, _ in held.value}
            stays = [not (i in known and (i, xxhash.xxh3_128_digest(texts[r].as_py().encode())) in held.value) for r, i in enumerate(batch.column(ids).to_pylist())]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

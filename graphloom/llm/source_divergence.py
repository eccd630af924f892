"""How far the words of each source lie from those of the other sources of its language, by integer-dictionary encoding.

Words are counted by (lang, source, term) in the tasks that read the texts. The kept terms of a language are dealt out by hash and sorted in UTF-8
order; runs of them are chunks. A chunk's sorted array gives each of its terms an id (searchsorted), counts become dense vectors of ids, one a source
(bincount), and all shares and divergences are integer operations on these vectors. Ids keep the order of terms, so ties fall as the
terms do. Chunks are independent; what they return is summed, or ranked again, by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import materialize, settled, text_column, trim

#: Bytes of a term to themselves, A-Z to a-z, every other byte to a space: a text's terms are then its words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a reading task holds, terms and counts of a chunk, cells of a dense block, cells of sums that a task holds.
HELD, TERMS, CELLS, BLOCK, SUMS = 1 << 19, 4096, 1 << 18, 1 << 20, 1 << 22
UNIT = 1_000_000_000

_CHUNK = "lang string, terms array<string>, sources array<string>, totals array<long>, src array<int>, term array<string>, n array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), counted over as many rows as HELD allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 1 << 16):
                part = terms[i : i + (1 << 16)]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in it:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_column(batch, "text")
        for lang, source, text in zip(langs, sources, texts):
            words = text.as_py().translate(_BYTES).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()
    trim()


def _chunks(it: Iterator[pa.RecordBatch], most_terms: int, cells: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n), sorted by lang and term, to chunks: whole terms of one lang with all their counts."""
    names = ["lang", "term", "source", "n"]
    empty = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())]).empty_table()
    held = empty

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        sources = rows["source"].combine_chunks().dictionary_encode()
        src, n = sources.indices.to_numpy(), rows["n"].to_numpy()
        totals = np.zeros(len(sources.dictionary), np.int64)
        np.add.at(totals, src, n)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array([rows["lang"][0].as_py()]), one(rows["term"].unique()), one(sources.dictionary), one(pa.array(totals)), one(sources.indices), one(rows["term"].combine_chunks()), one(rows["n"].combine_chunks())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "terms", "sources", "totals", "src", "term", "n"])

    def whole(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Chunks of the terms that are complete, and the rows of the one that may go on."""
        lang, term = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
        new = np.flatnonzero((np.diff(lang) != 0) | (np.diff(term) != 0)) + 1
        starts = np.concatenate([[0], new, [rows.num_rows]])
        made, begin, first = [], 0, 0
        for k in range(1, len(starts)):
            stop = starts[k]
            open_ = k == len(starts) - 1 and not last
            change = stop < rows.num_rows and lang[stop] != lang[stop - 1]
            if not open_ and (change or k - first >= most_terms or stop - begin >= cells or (last and k == len(starts) - 1)):
                made.append(chunk(rows.slice(begin, stop - begin)))
                begin, first = stop, k
        return made, rows.slice(begin)

    for batch in it:
        held = pa.concat_tables([held, pa.Table.from_batches([batch]).select(names)])
        if held.num_rows >= cells:
            made, held = whole(held, False)
            yield from made
    if held.num_rows:
        yield from whole(held, True)[0]


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / total), exactly: long division in three steps, right for totals below 2^53."""
    rest, out = counts + 1, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _compare(most: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with all sources of their lang (names, sums) and its number of terms to parts of sums (pair) and best terms of the chunk (term)."""
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}

        def rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array([source] * len(items), pa.string()), pa.array([part] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (names, sums) in pairs.items():
                for i, name in enumerate(names):
                    others = np.flatnonzero(np.arange(len(names)) != i)
                    if len(others):
                        yield rows(lang, name, "pair", [names[j] for j in others], sums[i, others])
            pairs.clear()

        for batch in it:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                lang, names, sums, size = get("lang").as_py(), get("names").as_py(), get("sums").values.to_numpy(), get("size").as_py()
                s = len(names)
                if lang not in pairs:
                    if sum(p[1].size for p in pairs.values()) + s * s > SUMS:
                        yield from out()
                    pairs[lang] = (names, np.zeros((s, s), np.int64))
                acc = pairs[lang][1]
                terms = np.array([t.encode() for t in get("terms").as_py()], object)
                if not len(terms):
                    continue
                where = np.searchsorted(np.array([x.encode() for x in names], object), np.array([x.encode() for x in get("sources").as_py()], object))
                ids = np.searchsorted(terms, np.array([t.encode() for t in get("term").as_py()], object))
                src, n = where[get("src").values.to_numpy()], get("n").values.to_numpy()
                own, all_ = (sums + size)[:, None], sums.sum() + size
                best: list[list[tuple]] = [[] for _ in names]
                width = max(1, block // s)
                for low in range(0, len(terms), width):
                    high = min(low + width, len(terms))
                    inside = (ids >= low) & (ids < high)
                    # each cell has one count, so the floats of bincount are exact below 2^53
                    dense = np.bincount(src[inside] * (high - low) + ids[inside] - low, n[inside], s * (high - low)).astype(np.int64).reshape(s, -1)
                    p = shares(dense, own)
                    q = shares(dense.sum(0), all_)
                    for i in range(s):
                        apart = p[i] - p
                        acc[i] += (apart * apart // p).sum(1)
                        over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                        if len(over):
                            value = (p[i, over] - q[over]) ** 2 // q[over]
                            top = np.lexsort((over, -value))[:most]
                            best[i] += zip((-value[top]).tolist(), (over[top] + low).tolist())
                for i, name in enumerate(names):
                    top = sorted(best[i])[:most]
                    if top:
                        yield rows(lang, name, "term", [terms[t].decode() for _, t in top], np.array([-v for v, _ in top], np.int64))
        yield from out()
        trim()

    return run


def divergence(docs: DataFrame, min_documents: int = 3, most_terms: int = 200, lang: str = "lang", source: str = "source", text: str = "text", terms: int = TERMS, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the lang, part `term` the most_terms terms that the source uses beyond its lang.

    Null lang, source and text are empty ones. A lang keeps the terms that min_documents of its rows have; repeated rows count as often as they stand. A
    group without kept terms has all shares from the smoothing alone; a lang without kept terms has pairs of value 0 and no terms; an empty table has no
    rows. Ties of value go by the item's UTF-8 bytes. A text's words are held at once, texts of a batch one after the other. The result has the square of
    a lang's number of sources in pairs, which is its meaning; a task holds the names of one lang's sources. terms, cells and block bound what a
    task holds of a chunk (whole terms in any case) and change no result.
    """
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    read = docs.select(blank(lang, "lang"), blank(source, "source"), F.col(text).alias("text"))

    def make() -> DataFrame:
        counted = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        within = counted.withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("df") >= min_documents)
        chunks = materialize(within.select("lang", "term", "source", "n").sortWithinPartitions("lang", "term").mapInArrow(lambda it: _chunks(it, terms, cells), _CHUNK))
        totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
        groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
        each = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"))
        sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"))
        # a lang's chunks go to several tasks, each of which needs the lang's row; one chunk without terms stands for the lang itself
        salts = 1 + chunks.count() // 8
        langs = materialize(each.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("names"), F.col("g.total").alias("sums"), F.coalesce("size", F.lit(0)).alias("size")))
        none = [F.array().cast(kind).alias(name) for name, kind in (c.split() for c in _CHUNK.split(", ")[1:])]
        work = chunks.unionByName(langs.select("lang", *none)).withColumn("salt", F.pmod(F.xxhash64("terms"), F.lit(salts)).cast("int"))
        told = work.join(langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"])
        found = materialize(told.select("lang", "terms", "sources", "src", "term", "n", "names", "sums", "size").mapInArrow(_compare(most_terms, block), _FOUND))
        rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pair = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(rank))
        term = found.filter("part = 'term'").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most_terms)
        return pair.unionByName(term)

    return settled(make)

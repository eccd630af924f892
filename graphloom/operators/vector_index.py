"""A stored vector index: packed blocks of near vectors with their centre and radius, brought up to date by what changed, searched exactly.

Blocks lie in committed versions. A refresh encodes only rows whose text changed, writes only the blocks that such rows and dropped ones lie in, and notes for every
block the version that holds it. A search first bounds each block: no vector of a block is nearer to a query than the block's centre by more than
the block's radius, as an angle. The most promising block of each query gives a score to beat, and only blocks that may beat it are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.tables import materialize, settled
from graphloom.versions import Versions

BLOCK = "block long, made string, ids array<string>, hashes array<string>, mat binary, center binary, radius double"
#: Vectors of a block, rows that lead the way when vectors are dealt out, numbers of a vector of terms, queries of one matrix.
SIZE, GUIDES, DIM, ASKED = 2048, 256, 256, 1024
#: What rounding may hide of a bound.
_SLACK = 2e-6


def node_text(nodes: DataFrame) -> DataFrame:
    """id, text of memories and intents: kind and statement, then the reasons, alternatives, scenarios and design that there are."""
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    some = lambda c: F.when(F.coalesce(has(c), F.lit("")) != "", F.array(has(c))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.coalesce(F.col("kind"), F.col("family")), F.lit(": "), F.coalesce(F.nullif(has("statement"), F.lit("")), F.col("label"), F.lit("")))
    scenarios = F.coalesce(F.col("scenarios"), F.array().cast("array<string>")) if "scenarios" in nodes.columns else F.array().cast("array<string>")
    memory, intent = F.concat(F.array(head), some("why"), some("alternatives")), F.concat(F.array(head), scenarios, some("design"))
    kept = nodes.filter("family in ('memory', 'intent')")
    return kept.select(F.col("node_id").alias("id"), F.array_join(F.when(F.col("family") == "memory", memory).otherwise(intent), "\n").alias("text"))


def encode(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """id, vec of texts (id, text): counts of terms, dampened and signed by hash, on dim numbers, of length 1; a text without terms has a vector of zeros.

    It needs no model; any other encoder that gives (id, vec) can take its place.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            made = []
            for hashes, counts in zip(frame["h"], frame["n"]):
                h, n = np.asarray(hashes, np.int64), np.asarray(counts, np.float64)
                vec = np.zeros(dim)
                np.add.at(vec, h % dim, np.where((h >> 40) & 1, 1.0, -1.0) * (1 + np.log(np.maximum(n, 1))))
                length = np.linalg.norm(vec)
                made.append(vec / length if length else vec)
            yield pd.DataFrame({"id": frame["id"], "vec": made})

    rows = texts.withColumn("t", T.terms(F.col("text"))).withColumn("u", F.array_distinct("t"))
    counted = rows.select("id", F.transform("u", lambda x: F.xxhash64(x)).alias("h"), F.transform("u", lambda x: F.size(F.filter("t", lambda y: y == x))).alias("n"))
    return counted.mapInPandas(run, "id string, vec array<double>")


def normalised(vec: Column) -> Column:
    """The vector of length 1 in its direction; zeros stay."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vec, lambda x: x.cast("double") / length)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix, without a detour through Python numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _packed(rows: DataFrame, made: str) -> DataFrame:
    """BLOCKs of rows (block, id, hash, vec), dealt by block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            mat = _vectors(table["vec"].combine_chunks())
            mean = mat.mean(0)
            length = np.linalg.norm(mean)
            center = mean / length if length else mean
            # a vector of zeros is at a right angle to all, as its cosines are 0
            radius = float(_angle(mat @ center).max()) if length else float(np.pi)
            one = lambda name: pa.array([table[name].to_pylist()], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([made]), one("id"), one("hash"), pa.array([mat.tobytes()], pa.binary()), pa.array([center.tobytes()], pa.binary()), pa.array([radius])], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in it:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    if held and numbers[a] != now:
                        yield out()
                        held.clear()
                    now = int(numbers[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return rows.select("block", "id", "hash", "vec").repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, BLOCK)


class Index:
    """The index below a folder."""

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE):
        self.spark, self.versions, self.size = spark, Versions(spark, path), size

    def manifest(self) -> DataFrame:
        """block, made: the blocks that count."""
        head = self.versions.head()
        return self.versions.read(head[0], "manifest") if head else self.spark.createDataFrame([], "block long, made string")

    def blocks(self) -> DataFrame:
        held = [f"{self.versions.path}/{v}/blocks" for v in self.versions.committed()]
        every = self.spark.read.schema(BLOCK).parquet(*held) if held else self.spark.createDataFrame([], BLOCK)
        return every.join(self.manifest(), ["block", "made"], "left_semi")

    def entries(self) -> DataFrame:
        """id, hash, block; vectors are not read."""
        return self.blocks().select("block", F.explode(F.arrays_zip("ids", "hashes")).alias("e")).select(F.col("e.ids").alias("id"), F.col("e.hashes").alias("hash"), "block")

    def refresh(self, wanted: DataFrame, encoder: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Makes the index hold wanted (id, text) and nothing else; with an encoder only changed texts go to it, without one wanted has vec too, and text tells changes. Returns whether anything changed.

        Ids are unique and not null. Vectors are brought to length 1.
        """
        told = wanted.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        now = materialize(self.entries())
        new = materialize(told.join(now.select("id", "hash"), ["id", "hash"], "left_anti").drop("hash"))
        gone = materialize(now.join(told.select("id", "hash"), ["id", "hash"], "left_anti"))
        if new.isEmpty() and gone.isEmpty():
            return False
        vectors = (encoder(new.select("id", "text")) if encoder else new.select("id", "vec")).withColumn("vec", normalised(F.col("vec")))
        hashed = materialize(vectors.join(new.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), "id"))
        made = uuid.uuid4().hex
        last = self.manifest().agg(F.coalesce(F.max("block"), F.lit(-1)).alias("b")).first().b
        # rows of touched blocks that stay, and changed ones, keep their block; others go to new blocks, near ones together
        touched = materialize(gone.select("block").distinct())
        kept = self._rows(self.blocks().join(touched, "block", "left_semi")).join(gone.select("id"), "id", "left_anti")
        home = hashed.join(now.select("id", "block"), "id", "left")
        fresh = self._dealt(home.filter("block is null").drop("block"), last + 1)
        rows = kept.unionByName(home.filter("block is not null").select("block", "id", "hash", "vec")).unionByName(fresh)
        packed = materialize(_packed(rows, made))
        manifest = self.manifest().join(touched, "block", "left_anti").unionByName(packed.select("block", "made"))
        self.versions.write({"blocks": packed, "manifest": manifest}, {"size": self.size}, prune=False)
        return True

    def _rows(self, blocks: DataFrame) -> DataFrame:
        """block, id, hash, vec of blocks."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for number, ids, hashes, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    flat = pa.array(_matrix(raw, len(ids)).ravel())
                    width = len(flat) // len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(ids), pa.array(hashes), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), flat)], names=["block", "id", "hash", "vec"])

        return blocks.select("block", "ids", "hashes", "mat").mapInArrow(run, "block long, id string, hash string, vec array<double>")

    def _dealt(self, rows: DataFrame, first: int) -> DataFrame:
        """Rows with block numbers from first on: each goes to its nearest guide, and a guide's rows fill blocks of size in the order of their hashes."""
        n = rows.count()
        guides = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(GUIDES, -(-n // self.size)))).select("vec").toArrow()["vec"].combine_chunks() if n else None  # a bounded number of rows
        if guides is None:
            return rows.select(F.lit(0).cast("long").alias("block"), "id", "hash", "vec").limit(0)
        held = self.spark.sparkContext.broadcast(_vectors(guides))

        def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                guide = (_vectors(batch.column(2)) @ held.value.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(guide, pa.int64())], names=["id", "hash", "vec", "guide"])

        near = materialize(rows.select("id", "hash", "vec").mapInArrow(nearest, "id string, hash string, vec array<double>, guide long"))
        # blocks of a guide are as many as its rows ask for, and a row's hash says which, so no order of all rows is needed
        parts = near.groupBy("guide").agg(F.ceil(F.count("*") / self.size).cast("long").alias("parts"))
        spans = sorted((r.guide, r.parts) for r in parts.collect())  # a row for each guide
        starts, begin = [], first
        for guide, count in spans:
            starts.append((guide, begin, count))
            begin += count
        place = self.spark.createDataFrame(starts, "guide long, begin long, parts long")
        return near.join(F.broadcast(place), "guide").select((F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "hash", "vec")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """id, vec of those of ids that the index holds."""
        at = self.entries().join(ids.select("id"), "id", "left_semi")
        return self._rows(self.blocks().join(at.select("block").distinct(), "block", "left_semi")).join(ids.select("id"), "id", "left_semi").select("id", "vec")

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, cosine, place: the k nearest vectors of each query (query string, qvec), exact to 6 digits, ties by id; a vector is not its own neighbour."""

        def make() -> DataFrame:
            asked = materialize(queries.select("query", normalised(F.col("qvec")).alias("qvec")))
            bounds = materialize(self._bounds(asked))
            first = bounds.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
            seen = materialize(self._scored(first, asked, k))
            # k scores of one block are a floor for the k-th of all
            floor = seen.groupBy("query").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("floor"))
            rest = bounds.join(first, ["query", "block"], "left_anti").join(floor, "query", "left").filter(F.coalesce(F.col("bound") >= F.col("floor"), F.lit(True))).select("query", "block")
            both = seen.unionByName(self._scored(rest, asked, k))
            key = F.struct((-F.col("cosine")).alias("d"), "id")
            some = both.groupBy("query", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.slice(F.array_sort(F.collect_list(key)), 1, k).alias("top"))
            merged = some.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
            return merged.select("query", F.posexplode("top").alias("i", "t")).select("query", F.col("t.id").alias("id"), (-F.col("t.d")).alias("cosine"), (F.col("i") + 1).alias("place"))

        return settled(make)

    def scores(self, qvec: list[float]) -> DataFrame:
        """id, cosine of every vector to one query."""
        one = np.asarray(qvec, np.float64)
        length = np.linalg.norm(one)
        unit = one / length if length else one

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.round(_matrix(raw, len(ids)) @ unit, 6))], names=["id", "cosine"])

        return self.blocks().select("ids", "mat").mapInArrow(run, "id string, cosine double")

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """query, block, bound: what no vector of the block exceeds. Queries come in packs; of blocks only centre and radius are read."""
        packs = _packs(asked)
        centers = self.blocks().select("block", "center", "radius")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for names, raw, block, center, radius in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    to = _angle(_matrix(raw, len(names)) @ np.frombuffer(center, np.float64))
                    bound = np.cos(np.maximum(0, to - radius)) + _SLACK
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([block] * len(names), pa.int64()), pa.array(bound)], names=["query", "block", "bound"])

        # packs of the stated queries against one row for each block
        return packs.crossJoin(centers).mapInArrow(run, "query string, block long, bound double")

    def _scored(self, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """query, id, cosine: the k best of each block for each query of pairs (query, block)."""
        salted = pairs.join(asked, "query").withColumn("pack", F.pmod(F.xxhash64("query"), F.lit(64)))
        packs = salted.groupBy("block", "pack").agg(F.collect_list(F.struct("query", "qvec")).alias("q")).select("block", F.col("q.query").alias("names"), F.col("q.qvec").alias("qvecs"))
        joined = packs.join(self.blocks().select("block", "ids", "mat"), "block").select("names", "qvecs", "ids", "mat")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for row in range(batch.num_rows):
                    names, ids = np.array(batch.column(0)[row].as_py(), object), np.array(batch.column(2)[row].as_py(), object)
                    near = np.round(_vectors(batch.column(1)[row].values) @ _matrix(batch.column(3)[row].as_py(), len(ids)).T, 6)
                    near[names[:, None] == ids[None, :]] = -np.inf
                    by_id = np.argsort(ids, kind="stable")  # ties go by id
                    order = by_id[np.argsort(-near[:, by_id], axis=1, kind="stable")[:, :k]]
                    rows, kept = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
                    value = near[rows, kept]
                    ok = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([pa.array(names[rows[ok]], pa.string()), pa.array(ids[kept[ok]], pa.string()), pa.array(value[ok])], names=["query", "id", "cosine"])

        return joined.mapInArrow(run, "query string, id string, cosine double")


def _packs(asked: DataFrame) -> DataFrame:
    """names, mat of queries (query, qvec), at most ASKED in a pack."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, ASKED):
                part = batch.slice(lo, ASKED)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.string())), pa.array([_vectors(part.column(1)).tobytes()], pa.binary())], names=["names", "mat"])

    return asked.mapInArrow(run, "names array<string>, mat binary")

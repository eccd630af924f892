"""Lexical and vector retrieval, fusion and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Config
from graphloom.functions import scores, text

#: Weight of an exact, a prefix and a substring match.
EXACT, PREFIX, SUBSTRING = 1.0, 0.6, 0.3


def postings(nodes: DataFrame, body: str) -> DataFrame:
    """node_id, term: the distinct terms of each node, made distinct before any shuffle."""
    return nodes.select("node_id", F.explode(F.array_distinct(text.terms(F.col(body)))).alias("term"))


def idf(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + N / df)."""
    total = nodes.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", "df", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def match_scores(terms: DataFrame, weights: DataFrame, query: list[str]) -> DataFrame:
    """node_id, score: for each query term its weight (ln 2 where unknown) times the best way in which a node's terms match it.

    The query is a few words, so its terms are an array constant tested against each distinct term, not a join with the postings.
    """
    asked = terms.sparkSession.createDataFrame([(i, q) for i, q in enumerate(query)], "i int, q string")
    known = asked.join(weights.select(F.col("term").alias("q"), "idf"), "q", "left").select("i", "q", F.coalesce("idf", F.log(F.lit(2.0))).alias("w"))
    t, q = F.col("term"), F.col("q")
    how = F.when(t == q, EXACT).when(F.startswith(t, q) | F.startswith(q, t), PREFIX).when(F.contains(t, q), SUBSTRING)
    # distinct terms x the words of one query, which bound the broadcast side
    vocabulary = weights.select("term").crossJoin(F.broadcast(known)).withColumn("how", how).filter("how is not null").select("term", "i", "w", "how")
    best = terms.join(vocabulary, "term").groupBy("node_id", "i").agg(F.max("how").alias("how"), F.first("w").alias("w"))
    return best.groupBy("node_id").agg(F.sum(F.col("w") * F.col("how")).alias("score"))


def seeds(match: DataFrame, c: Config = DEFAULTS) -> DataFrame:
    """node_id, score, place: the best nodes up to the first drop by more than half."""
    top = match.orderBy(F.desc("score"), "node_id").limit(min(c.seeds, c.seed_cap))
    order = Window.orderBy(F.desc("score"), "node_id")
    before = F.lag("score").over(order)
    cut = F.max(F.when(F.col("score") < c.gap * before, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.select("node_id", "score", (F.row_number().over(order) - 1).alias("place"), cut.alias("cut")).filter("cut = 0").drop("cut")


def merge_seeds(first: DataFrame, second: DataFrame) -> DataFrame:
    """node_id, place: the first list, then what only the second has."""
    both = first.select("node_id", F.lit(0).alias("s"), "place").unionByName(second.select("node_id", F.lit(1).alias("s"), "place"))
    once = both.groupBy("node_id").agg(F.min(F.struct("s", "place")).alias("m"))
    return once.select("node_id", (F.row_number().over(Window.orderBy("m", "node_id")) - 1).alias("place"))


def _scaled(df: DataFrame, *values: str) -> DataFrame:
    """df with each of values scaled to its own range; the ranges are one row."""
    ends = df.agg(*(f(v).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("_lo", F.min), ("_hi", F.max))))
    both = df.crossJoin(F.broadcast(ends))  # one row
    scaled = lambda i, v: F.when(F.col(f"_hi{i}") - F.col(f"_lo{i}") < 1e-12, 0.0).otherwise((F.col(v) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return both.select(*(c for c in df.columns if c not in values), *(scaled(i, v).alias(v) for i, v in enumerate(values)))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """node_id, match: the greater of two scores, each scaled to its own range over its positive values."""
    part = lambda df: _scaled(df.filter("score > 0").select("node_id", "score"), "score").withColumnRenamed("score", "s")
    return part(a).unionByName(part(b)).groupBy("node_id").agg(F.max("s").alias("match"))


def rank(slice_: DataFrame, c: Config = DEFAULTS) -> DataFrame:
    """(node_id, hops, match, relevance) to (node_id, final, place): the best node_budget rows, scaled over all of them. Only those are numbered."""
    rows = slice_.select("node_id", F.coalesce("match", F.lit(0.0)).alias("match"), (1.0 / (1.0 + F.col("hops"))).alias("near"), "relevance")
    scaled = _scaled(rows, "match", "near", "relevance")
    scored = scaled.select("node_id", F.round(c.alpha * F.col("match") + c.beta * F.col("near") + c.gamma * F.col("relevance"), 6).alias("final"))
    best = scored.orderBy(F.desc("final"), "node_id").limit(c.node_budget)
    return best.select("node_id", "final", F.row_number().over(Window.orderBy(F.desc("final"), "node_id")).alias("place"))


def fill_budget(lines: DataFrame, budget: int) -> DataFrame:
    """(place, node_id, cost) to the lines that fit when taken in order, skipping those that do not; one packet of bounded size."""
    packet = lines.agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "cost"))).alias("l"))
    kept = packet.select("l", scores.greedy_fill(F.transform("l", lambda x: x.cost), budget).alias("k"))
    return kept.select(F.explode(F.transform("k", lambda i: F.get("l", i))).alias("x")).select("x.place", "x.node_id", "x.cost")


#: Vectors of a packed block: a matrix product of two blocks is one step of a task.
VECTORS = 2048


def _pack(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(group, id, vec) rows, those of one group beside each other, to (group, ids, mat): blocks of one group of at most size rows."""
    held: list[pa.RecordBatch] = []
    count, now = 0, None

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        mat = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column(1).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([mat.tobytes()], pa.binary())], ["group", "ids", "mat"])

    for batch in it:
        codes = batch.column(0).dictionary_encode()
        numbers = codes.indices.fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            while begin < end:
                group = batch.column(0)[begin].as_py()
                if held and (group != now or count >= size):
                    yield out()
                    held, count = [], 0
                part = batch.slice(begin, min(end - begin, size - count))
                held.append(part)
                now, count, begin = group, count + part.num_rows, begin + part.num_rows
    if held:
        yield out()


def blocks(vectors: DataFrame, group: Column) -> DataFrame:
    """group, ids, mat of vectors (id, vec): rows of a group lie together in blocks; a group of any size is many blocks."""
    rows = vectors.select(group.cast("string").alias("group"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    near = rows.repartitionByRange("group", "id").sortWithinPartitions("group", "id")
    size = VECTORS
    return near.mapInArrow(lambda it: _pack(it, size), "group string, ids array<long>, mat binary")


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, cosine, place: the k nearest vectors (id, vec) of each query (query, qvec), exact; a vector is not its own neighbour.

    Queries and vectors are packed into blocks. Each pair of a query block and a vector block is a matrix product that leaves k rows of each query.
    """
    none = F.lit("")
    ours = blocks(vectors, none).select("ids", "mat")
    asked = blocks(queries.select(F.col("query").alias("id"), F.col("qvec").alias("vec")), none).select(F.col("ids").alias("qids"), F.col("mat").alias("qmat"))

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, mat, qids, qmat in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ids, qids = np.array(ids), np.array(qids)
                near = np.round(_matrix(qmat, len(qids)) @ _matrix(mat, len(ids)).T, 6)
                near[qids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
                rows, kept = np.repeat(np.arange(len(qids)), order.shape[1]), order.ravel()
                value = near[rows, kept]
                ok = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows[ok]]), pa.array(ids[kept[ok]]), pa.array(value[ok])], ["query", "id", "cosine"])

    pairs = ours.crossJoin(asked).mapInArrow(best, "query long, id long, cosine double")  # blocks of the stated query set against blocks of all rows
    key = F.struct((-F.col("cosine")).alias("d"), "id")
    some = pairs.groupBy("query", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.slice(F.array_sort(F.collect_list(key)), 1, k).alias("top"))
    merged = some.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("query", F.posexplode("top").alias("i", "t")).select("query", F.col("t.id").alias("id"), (-F.col("t.d")).alias("cosine"), (F.col("i") + 1).alias("place"))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """anchor, left_id, right_id, cosine of vectors (id, anchor, vec) on the same anchor with at least this cosine, each pair once at its least anchor."""
    return near_pairs(vectors, threshold).groupBy("left_id", "right_id").agg(F.min("anchor").alias("anchor"), F.max("cosine").alias("cosine"))


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """The similar pairs, once for each anchor that both vectors lie on: they have not moved yet.

    The vectors of an anchor are packed into blocks, and pairs of blocks are compared: a crowded anchor is many tasks, and only pairs above the threshold are rows.
    """
    left = blocks(vectors, F.col("anchor")).filter("group is not null")
    right = left.select("group", F.col("ids").alias("rids"), F.col("mat").alias("rmat"))
    # of two blocks of an anchor, the one with the lower ids goes left
    joined = left.join(right, "group").filter(F.get("ids", F.lit(0)) <= F.get("rids", F.lit(0)))

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for group, ids, mat, rids, rmat in zip(*(batch.column(c).to_pylist() for c in range(5))):
                ids, rids = np.array(ids), np.array(rids)
                value = np.round(_matrix(mat, len(ids)) @ _matrix(rmat, len(rids)).T, 6)
                a, b = np.nonzero((value >= threshold) & (ids[:, None] != rids[None, :]))
                if ids[0] == rids[0]:  # a block with itself has each pair twice
                    a, b = a[ids[a] < rids[b]], b[ids[a] < rids[b]]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(a), pa.string()), pa.array(np.minimum(ids[a], rids[b])), pa.array(np.maximum(ids[a], rids[b])), pa.array(value[a, b])], ["anchor", "left_id", "right_id", "cosine"])

    return joined.mapInArrow(near, "anchor string, left_id long, right_id long, cosine double")


def nearest_on_anchor(vectors: DataFrame, threshold: float) -> DataFrame:
    """id, twin, cosine: the most similar other vector on the same anchor, where it is similar enough to refuse a new one."""
    pairs = similar_pairs(vectors, threshold)
    both = pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("twin"), "cosine").unionByName(pairs.select(F.col("right_id").alias("id"), F.col("left_id").alias("twin"), "cosine"))
    return both.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("d"), "twin")).alias("m")).select("id", "m.twin", (-F.col("m.d")).alias("cosine"))

"""Exact histogram of encoded lengths, and totals for every context limit from its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import read_ranks

#: Lengths of a block: a block's lengths meet in a task, and the blocks' sums in one.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """length, docs: how many rows of docs have so many tokens, summed within each partition only. A null text has no tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # special_tokens is empty: their strings are ordinary text
        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        counts: dict[int, int] = {}
        for batch in it:
            for value in batch.column(0):
                n = len(code.encode_ordinary(value.as_py() or ""))
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "docs"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "length long, docs long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, from rows (length, docs).

    docs_at_least and tokens_at_least are suffix sums, docs_shorter the rest; tokens_truncated is the total when every document
    is cut at this length as context limit: the tokens of shorter documents plus length for each other. quantile is the share of
    documents of at most this length. Any other limit has the docs_at_least of the next length. No documents: no rows.
    """
    per = lengths.groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("block", F.floor(F.col("length") / BLOCK).cast("long"))
    tokens = F.col("docs") * F.col("length")
    # a block's lengths travel with its sums, so the texts are encoded once
    blocks = per.groupBy("block").agg(F.collect_list(F.struct("length", "docs")).alias("l"), F.sum("docs").alias("bd"), F.sum(tokens).alias("bt"))
    # one row for each 1024 lengths that occur: the longest document bounds them
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    after = blocks.select("block", "l", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("at"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    each = after.select("block", F.inline("l"), "ad", "at", "all_docs", "all_tokens")
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = each.select("*", F.sum("docs").over(inside).alias("d"), F.sum(tokens).over(inside).alias("t"))
    at_least, more = F.col("d") + F.col("ad"), F.col("t") + F.col("at")
    return sums.select(
        "length",
        "docs",
        at_least.alias("docs_at_least"),
        more.alias("tokens_at_least"),
        (F.col("all_docs") - at_least).alias("docs_shorter"),
        (F.col("all_tokens") - more + F.col("length") * at_least).alias("tokens_truncated"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """The answer for one context limit: total (tokens when every document is cut at limit), cut (documents above it)."""
    first = sums.filter(F.col("length") >= limit).agg(F.min("length").alias("length")).join(sums, "length")
    above = first.select((F.col("tokens_truncated") - (F.col("length") - limit) * F.col("docs_at_least")).alias("total"), F.when(F.col("length") > limit, F.col("docs_at_least")).otherwise(F.col("docs_at_least") - F.col("docs")).alias("cut"))
    whole = sums.agg(F.sum(F.col("docs") * F.col("length")).alias("total"), F.lit(0).cast("long").alias("cut"), F.max("length").alias("m")).filter(F.coalesce("m", F.lit(0)) < limit).select(F.coalesce("total", F.lit(0)).alias("total"), "cut")
    return above.unionByName(whole)


def count(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    return histogram(encoded_lengths(docs, path, pattern, text))

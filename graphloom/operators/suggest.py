"""Suggestions for ids that do not exist: the most similar ones by the share of matching blocks, without comparing all pairs.

The ratio of two texts is twice their matching characters over all their characters. Matching characters are common characters, counted as often as both have
them, so a pair above the cut-off shares many of them: numbered characters (the second e, say) are tokens, and two texts whose rarest tokens have none in common
share too few. What is left is bounded by its common characters and then compared exactly.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tokens(text: Column) -> Column:
    """Each character with the number of times that it has come so far."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string"), F.lit(":"), c))


def _prefixes(texts: DataFrame, name: str, cutoff: float) -> DataFrame:
    """name, token of those tokens of each text, the rarest first, of which a text that is similar enough has at least one."""
    each = texts.select(name, F.length(name).alias("n"), F.explode(_tokens(F.col(name))).alias("token"))
    rare = each.join(each.groupBy("token").agg(F.count("*").alias("c")), "token")
    # the shorter of two similar texts has at least cutoff / (2 - cutoff) of the characters of the longer one
    least = F.ceil(F.col("n") * (cutoff / 2) * (1 + cutoff / (2 - cutoff)) - 1e-9)
    order = F.row_number().over(Window.partitionBy(name).orderBy("c", "token"))
    return rare.withColumn("i", order).filter(F.col("i") <= F.col("n") - least + 1).select(name, "token")


def suggest(asked: DataFrame, known: DataFrame, most: int = 3, cutoff: float = 0.6) -> DataFrame:
    """asked, suggestion, ratio, place: for each of asked (asked) the most similar of known (id) with at least the ratio cutoff; of equal ratios the greater id comes first.

    Nulls and empty texts have no suggestions; repeated rows count once. The ratio is not symmetric: the known id is the first text.
    """
    wanted = asked.select("asked").filter("asked <> ''").distinct()
    have = known.select("id").filter("id <> ''").distinct()
    # both sides go by one order of tokens
    both = wanted.select(F.col("asked").alias("t")).unionByName(have.select(F.col("id").alias("t"))).distinct()
    prefix = _prefixes(both, "t", cutoff)
    ours = prefix.join(wanted.withColumnRenamed("asked", "t"), "t", "left_semi").withColumnRenamed("t", "asked")
    theirs = prefix.join(have.withColumnRenamed("id", "t"), "t", "left_semi").withColumnRenamed("t", "id")
    la, lb = F.length("asked"), F.length("id")
    near = ours.join(theirs, "token").filter(2 * F.least(la, lb) >= cutoff * (la + lb) - 1e-9).select("asked", "id").distinct()
    common = F.size(F.array_intersect(_tokens(F.col("asked")), _tokens(F.col("id"))))
    close = near.filter(2 * common >= cutoff * (la + lb) - 1e-9)

    def ratios(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = difflib.SequenceMatcher()
        for batch in it:
            out = []
            for word, id_ in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if match.b != word:
                    match.set_seq2(word)
                match.set_seq1(id_)
                out.append((word, id_, match.ratio()))
            rows = [r for r in out if r[2] >= cutoff]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["asked", "suggestion", "ratio"])

    found = close.select("asked", "id").mapInArrow(ratios, "asked string, suggestion string, ratio double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("suggestion")))
    return found.withColumn("place", place).filter(F.col("place") <= most)

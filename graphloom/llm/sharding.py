"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Rows are numbered without gaps in an order that only their values decide. A balanced Feistel network over the pairs
(x // b, x mod b) of an a-by-b domain that just holds all row numbers permutes them; cycle walking repeats it until the
value is a row number again. Permuted number p goes to shard p mod shards, slot p div shards: both follow from the row
number, the row count and the seed, however the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import fresh

#: Buckets of the numbering: rows meet in a task by bucket, and only buckets' counts meet in one.
BUCKETS = 4096
ROUNDS = 6
#: Steps of the walk. The domain has fewer than sqrt(n) + 1 values beyond n, so one in about sqrt(n) walks takes a second step.
WALKS = 48


def permute(x: Column, n: Column, seed: int = 0) -> Column:
    """The place of row number x among n, a bijection of 0 to n - 1."""
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"))

        def turn(s: Column, k: Column) -> Column:
            from_right = (s.l + F.pmod(F.xxhash64(s.r, k, F.lit(seed)), a)) % a
            from_left = (s.r + F.pmod(F.xxhash64(s.l, k, F.lit(seed)), b)) % b
            even = k % 2 == 0
            return F.struct(F.when(even, from_right).otherwise(s.l).alias("l"), F.when(even, s.r).otherwise(from_left).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, turn, lambda s: s.l * b + s.r)

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), network(x), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.element_at(F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))), 1)


def number_rows(rows: DataFrame, number: str, total: str) -> DataFrame:
    """Adds a gapless row number from 0 and the row count.

    The order is by a hash bucket of all columns, then by the columns. Equal rows are counted before any shuffle and spread
    again at the end, so copies, however many, never meet in one task. Map columns cannot be compared and must be cast before. number and total must be new names.
    """
    columns = rows.columns
    copies, bucket, n, before, within, copy = (fresh(rows, c) for c in ("_copies", "_bucket", "_n", "_before", "_within", "_copy"))
    distinct = rows.groupBy(*columns).agg(F.count("*").alias(copies)).withColumn(bucket, F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    per = distinct.groupBy(bucket).agg(F.sum(copies).alias(n))
    # at most BUCKETS rows
    ordered = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    offsets = per.select(bucket, (F.sum(n).over(ordered) - F.col(n)).alias(before), F.sum(n).over(everything).alias(total))
    inside = Window.partitionBy(bucket).orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = distinct.withColumn(within, F.sum(copies).over(inside) - F.col(copies)).join(F.broadcast(offsets), bucket)
    spread = F.explode(F.sequence(F.lit(0), F.col(copies) - 1).cast("array<long>"))
    return placed.withColumn(copy, spread).select(*columns, total, (F.col(before) + F.col(within) + F.col(copy)).alias(number))


def shard(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Adds shard and slot to all rows: shard sizes differ by at most one row, slots of a shard run from 0 without gaps.

    Nulls are values like others; repeated rows get places of their own; an empty table stays empty; input columns named
    shard or slot are replaced, all other names are free.
    """
    rows = rows.select(*(c for c in rows.columns if c.lower() not in ("shard", "slot")))
    number, total, place = (fresh(rows, c) for c in ("_number", "_total", "_place"))
    placed = number_rows(rows, number, total).withColumn(place, permute(F.col(number), F.col(total), seed))
    return placed.select(*rows.columns, (F.col(place) % shards).cast("int").alias("shard"), F.floor(F.col(place) / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Writes the rows as Parquet folders shard=k. A shard is written by as many tasks as its size asks for, in files of adjoining slots, each sorted by slot."""
    placed = shard(rows, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

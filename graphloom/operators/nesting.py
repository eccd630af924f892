"""Qualified names of definitions from their spans: a definition belongs to the nearest one whose span holds its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "file string, first long, last long, name string, kind string, container string, qualname string"


def _stacked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each file by first, the longer first, to spans with their container and qualname; only what is open is held."""
    now: str | None = None
    open_: list[tuple[int, str]] = []
    for batch in it:
        containers, names = [], []
        for file, first, last, name in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if file != now:
                now, open_ = file, []
            # one that ends before this one ends cannot hold it, nor anything that comes later and is not in this one
            while open_ and open_[-1][0] < last:
                open_.pop()
            container = open_[-1][1] if open_ else None
            names.append(f"{container}.{name}" if container else name)
            containers.append(container)
            open_.append((last, names[-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(containers, pa.string()), pa.array(names, pa.string())], names=[*batch.schema.names, "container", "qualname"])


def nest(spans: DataFrame) -> DataFrame:
    """file, first, last, name, kind, container (a qualname, null at the top) and qualname of definitions (file, first, last, name, kind); ends are inclusive.

    Definitions without a name, a file or a span are left out. Of several on one span the least by name and kind stands; of several with one qualname in a file
    the first, and what they hold belongs to that name. Spans may overlap without nesting: then neither holds the other.
    """
    good = spans.filter("file is not null and first <= last and name <> ''")
    once = good.groupBy("file", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).agg(F.min(F.struct("name", "kind")).alias("d")).select("file", "first", "last", "d.name", "d.kind")
    nested = once.repartition("file").sortWithinPartitions("file", "first", F.desc("last")).mapInArrow(_stacked, _OUT)
    order = F.row_number().over(Window.partitionBy("file", "qualname").orderBy("first", F.desc("last")))
    return nested.withColumn("_n", order).filter("_n = 1").drop("_n")


def contains(nested: DataFrame) -> DataFrame:
    """src, dst, relation: each symbol below its container, or below its file's module."""
    symbol = lambda name: F.concat(F.lit("sym:"), F.col("file"), F.lit("#"), F.col(name))
    src = F.when(F.col("container").isNull(), F.concat(F.lit("module:"), F.col("file"))).otherwise(symbol("container"))
    return nested.select(src.alias("src"), symbol("qualname").alias("dst"), F.lit("contains").alias("relation"))

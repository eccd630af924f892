"""Helpers of the operators: written tables, fresh names, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.tables import discard, materialize, scratch, settled, small

__all__ = ["batches", "discard", "fresh", "materialize", "reachable", "release", "scratch", "settled", "small", "text_column", "trim"]

#: Text bytes that one pass of a NumPy kernel holds.
SLICE_BYTES = 1 << 20


def reachable(spark: SparkSession) -> None:
    """Tells Python workers where this package lies, for drivers that have it on sys.path but not in PYTHONPATH."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more; Spark drops them when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the machine, as workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, compared as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as UTF-8 bytes with 64-bit offsets; null becomes empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("")
    return arr.cast(pa.large_binary())


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weigh=None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most size rows, or of about most bytes where weigh tells a row's bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

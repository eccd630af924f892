"""Written tables: results between jobs go to the shared folder of the cluster, so lineage ends at files that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_SCOPES: list[list[DataFrame]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir). Where it is unset, a local master gets a new folder; a cluster, whose machines share none, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that are materialized inside, so that those which only led to a result can be discarded after it."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()


def settled(make) -> DataFrame:
    """make()'s rows as a written table; the tables written on the way are removed."""
    with scratch() as made:
        made_last = materialize(make())
    for df in made:
        if df is not made_last:
            discard(df)
    if _SCOPES:
        _SCOPES[-1].append(made_last)
    return made_last


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most so many rows, which is what allows a broadcast."""
    return df.limit(most + 1).count() <= most


def apart(df: DataFrame) -> DataFrame:
    """df, which joins of it do not broadcast by the size of its files: packed files of a growing table are many times larger as rows."""
    out = df.hint("merge")
    out._graphloom_path = getattr(df, "_graphloom_path", None)
    return out

"""The log as a stream: idempotent ingest, and a view of which each batch folds the touched ids again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import log

SCHEMA = "project long, seq long, id string, session long, actor long, family string, body string"


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def _folders(spark: SparkSession, path: str, stem: str) -> list[int]:
    """Numbers of the folders stem=n below path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(stem + "="))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_key", log.event_key(F.col("project"), F.col("id"), F.col("body")))


def ingest(events: DataFrame, table: str, view: str, checkpoint: str):
    """Appends each batch's new events to the table path and brings the collapsed view up to date; returns the running query.

    An event is known by its event_key (project, id, body), whatever its seq: of several the least seq counts. A batch reads the keys of the table, and of the view it
    folds the ids again that the batch touches; the others are carried over. A batch that runs again overwrites its own folders. The view before the last one is removed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        first = Window.partitionBy("event_key").orderBy("seq")
        once = keyed(rows).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        before = [n for n in _folders(spark, table, "batch") if n < number]
        schema = SCHEMA + ", event_key string, batch long"
        if before:
            held = spark.read.schema(schema).parquet(table).filter(F.col("batch") < number)
            once = once.join(held.select("event_key"), "event_key", "left_anti")
        once.select(*(c.split()[0] for c in SCHEMA.split(", ")), "event_key").write.mode("overwrite").parquet(f"{table}/batch={number}")
        whole = spark.read.schema(schema).parquet(table).filter(F.col("batch") <= number)
        touched = whole.filter(F.col("batch") == number).select("id").distinct()
        fresh = log.collapse(whole.join(touched, "id", "left_semi"))
        heads = [n for n in _folders(spark, view, "head") if n < number]
        if heads:
            old = spark.read.parquet(f"{view}/head={heads[-1]}")
            fresh = fresh.unionByName(old.join(touched, "id", "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{view}/head={number}")
        for n in heads[:-1]:
            _remove(spark, f"{view}/head={n}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def head(spark: SparkSession, view: str) -> DataFrame:
    """The view of the latest batch."""
    return spark.read.parquet(f"{view}/head={_folders(spark, view, 'head')[-1]}")


def is_current(view: DataFrame, events: DataFrame) -> bool:
    """Whether the view holds every event of the log."""
    return (view.agg(F.sum("events")).first()[0] or 0) == keyed(events).select("event_key").distinct().count()

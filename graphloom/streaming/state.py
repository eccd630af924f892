"""Streams with state of their own: the chain of each project's log, and what each session has been told.

State lies in Spark's state store and is checkpointed with the stream, so a stream that starts again goes on from it. Rows of a project meet in one task, as a
chain and a latch are serial; a trigger bounds how many come at once (maxFilesPerTrigger of the source).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from graphloom.operators import log

ENTRY = "project long, seq long, id string, body string, event_key string, prev_hash string, entry_hash string"
TOLD = "project long, session string, at long, key string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State of several variables needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class Chain(StatefulProcessor):
    """Numbers a project's new events from 1 and links each to the one before. Events whose key the chain has are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", StructType([StructField("seq", LongType()), StructField("entry_hash", StringType())]))
        self.known = handle.getMapState("known", StructType([StructField("event_key", StringType())]), StructType([StructField("seq", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.tail.get() if self.tail.exists() else None
        seq, last = (held[0], held[1]) if held else (0, log.GENESIS)
        now = set()  # a chain that begins here is asked for no key: all that it has came with these rows
        for r in sorted(rows, key=lambda r: (r.seq, r.id, r.event_key)):
            if r.event_key in now or (held and self.known.containsKey((r.event_key,))):
                continue
            now.add(r.event_key)
            seq += 1
            entry = hashlib.sha256(f"{last}\0{r.event_key}".encode()).hexdigest()
            self.known.updateValue((r.event_key,), (seq,))
            yield Row(project=key[0], seq=seq, id=r.id, body=r.body, event_key=r.event_key, prev_hash=last, entry_hash=entry)
            last = entry
        self.tail.update((seq, last))

    def close(self) -> None:
        pass


class Latch(StatefulProcessor):
    """Tells each session of a project which of the open obligations it has not been told of.

    A report has all keys that are open. A key that is no longer open is forgotten, so if it comes back it is told again. A report with the
    fingerprint of the session's last one says nothing. Only the sessions that reported last are remembered.
    """

    def __init__(self, sessions: int = 20):
        self.sessions = sessions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", StructType([StructField("session", StringType())]), StructType([StructField("at", LongType()), StructField("fingerprint", StringType()), StructField("keys", ArrayType(StringType()))]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {k[0]: (v[0], v[1], set(v[2])) for k, v in self.told.iterator()}
        touched = set()
        for r in sorted(rows, key=lambda r: (r.at, r.session)):
            _, fingerprint, known = held.get(r.session, (None, None, set()))
            live = set(r.keys or ())
            if r.fingerprint is None or r.fingerprint != fingerprint:
                for k in sorted(live - known):
                    yield Row(project=key[0], session=r.session, at=r.at, key=k)
                known = live
            held[r.session] = (r.at, r.fingerprint, known)
            touched.add(r.session)
            if len(held) > self.sessions:
                oldest = min(held, key=lambda s: (held[s][0], s))
                del held[oldest]
                touched.add(oldest)
        for session in touched:
            if session in held:
                at, fingerprint, known = held[session]
                self.told.updateValue((session,), (at, fingerprint, sorted(known)))
            elif self.told.containsKey((session,)):
                self.told.removeKey((session,))

    def close(self) -> None:
        pass


def chained(events: DataFrame) -> DataFrame:
    """ENTRY of a stream of events (project, seq, id, body): seq of the result counts the project's own chain. Events come in any order; those of one trigger go in by seq."""
    prepare(events.sparkSession)
    keyed = events.select("project", "seq", "id", "body", log.event_key(F.col("project"), F.col("id"), F.col("body")).alias("event_key"))
    return keyed.groupBy("project").transformWithState(Chain(), ENTRY, "append", "none")


def announced(reports: DataFrame, sessions: int = 20) -> DataFrame:
    """TOLD of a stream of reports (project, session, at, fingerprint, keys): a row for each key that is new to its session."""
    prepare(reports.sparkSession)
    return reports.select("project", "session", "at", "fingerprint", "keys").groupBy("project").transformWithState(Latch(sessions), TOLD, "append", "none")


def run(stream: DataFrame, table: str, checkpoint: str):
    """Appends what a stream makes of all that has come to the table path; returns the running query. A batch that runs again is not written twice."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def announcements(reports: DataFrame) -> DataFrame:
    """TOLD of all reports at once, for a table: what is open now and was not in the session's report before."""
    none = F.array().cast("array<string>")
    open_ = reports.select("project", "session", "at", F.coalesce("keys", none).alias("keys"))
    before = open_.withColumn("before", F.lag("keys").over(Window.partitionBy("project", "session").orderBy("at")))
    return before.select("project", "session", "at", F.explode(F.array_except("keys", F.coalesce("before", none))).alias("key"))

"""What is known of nodes only at the time of reading: counters as of then, two clocks of survival, and the maturity that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Config
from graphloom.functions import scores


def as_of(reads: DataFrame, counters: DataFrame) -> DataFrame:
    """reads (node_id, at) with the columns of the node's last row of counters (node_id, ts, ...) that is not after it; nulls where there is none.

    Reads and rows of a node are put in one order of time, so no read meets more than the rows before it; at equal times the row comes first, and of
    several rows of one time the one with the greatest values counts.
    """
    values = [c for c in counters.columns if c not in ("node_id", "ts")]
    rows = counters.groupBy("node_id", "ts").agg(F.max(F.struct(*values)).alias("v"))
    kind = rows.schema["v"].dataType
    marked = rows.select("node_id", F.col("ts").alias("at"), F.lit(0).alias("read"), "v").unionByName(reads.select("node_id", "at", F.lit(1).alias("read"), F.lit(None).cast(kind).alias("v")))
    before = Window.partitionBy("node_id").orderBy("at", "read").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("v", F.last("v", ignorenulls=True).over(before)).filter("read = 1").select("node_id", "at", "v.*")


def survival(nodes: DataFrame, commits: DataFrame, shared: DataFrame) -> DataFrame:
    """node_id, survival: the greater of what the commits and the shared log say (node_id, survival each); both can only count too little, so the greater is nearer."""
    two = nodes.select("node_id").join(commits.select("node_id", F.col("survival").alias("a")), "node_id", "left").join(shared.select("node_id", F.col("survival").alias("b")), "node_id", "left")
    return two.select("node_id", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("long").alias("survival"))


def overlay(memories: DataFrame, counters: DataFrame, clocks: DataFrame, at: int, measurable: bool = True, c: Config = DEFAULTS) -> DataFrame:
    """node_id, usage, last_seen, upholds, survival, was, maturity of memories (node_id, maturity, superseded_in) as read at a time.

    A memory that is not superseded is settled by upholds, a proposed one stays proposed until it is confirmed by some. A floor of survival counts only where
    a clock can measure. Counters of nodes that are no memories are passed over.
    """
    now = as_of(memories.select("node_id", F.lit(at).cast("long").alias("at")).distinct(), counters).drop("at")
    both = memories.join(now, "node_id").join(clocks, "node_id", "left")
    upholds, alive = F.coalesce("upholds", F.lit(0.0)), F.coalesce("survival", F.lit(0))
    verdict = scores.maturity_verdict(F.col("maturity"), upholds, F.col("superseded_in"), alive, F.lit(measurable), c)
    return both.select("node_id", F.coalesce("usage", F.lit(0)).alias("usage"), "last_seen", upholds.alias("upholds"), alive.cast("long").alias("survival"), F.col("maturity").alias("was"), verdict.alias("maturity"))

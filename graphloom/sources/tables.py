"""The driver's star tables as a typed graph, a log and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    base = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))
    content = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("|", base, F.col("p_partkey").cast("string"))).otherwise(base)
    return part.select("p_partkey", "p_name", F.sha2(content, 256).alias("content_hash"))


_VIEWS: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The materialized view of the graph: built once in an application and kept by Spark (in memory, else on disk), as its queries share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VIEWS:
        built = build(spark, sf_dir)
        # sizes of files and of packed columns say little of rows, so Spark is not to broadcast what comes from the view by them
        _VIEWS[key] = Graph(*(df.persist().hint("merge") for df in (built.nodes, built.edges, built.dangling)))
    return _VIEWS[key]


def build(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: read(spark, sf_dir, name)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    parts = part_hashes(spark, sf_dir)
    apart = parts.hint("merge")  # lines come out by part, so a part's hash is near-by; a table that grows is not broadcast however well its file is compressed

    def nodes(df: DataFrame, node_id, family, kind, label, status=none, state=none, maturity=none, grounding=none, attestation=none, content=none) -> DataFrame:
        return df.select(node_id.alias("node_id"), F.lit(family).alias("family"), F.lit(kind).alias("kind"), label.alias("label"), status.alias("status"), state.alias("state"), maturity.alias("maturity"), grounding.alias("grounding"), attestation.alias("attestation"), content.alias("content_hash"))

    pick = lambda c, n, **by: F.coalesce(*(F.when(F.col(c) % n == int(k[1:]), v) for k, v in by.items()))
    n = F.col("n_nationkey")
    all_nodes = [
        nodes(t("region"), key("int:r", "r_regionkey"), "intent", "goal", F.col("r_name"), status=F.lit("active")),
        nodes(t("nation"), key("int:n", "n_nationkey"), "intent", "requirement", F.col("n_name"), status=F.when(n % 7 == 3, "archived").when(n % 5 == 1, "satisfied").otherwise("active")),
        nodes(t("customer"), key("mem:c", "c_custkey"), "memory", "decision", F.col("c_name"), status=F.when(F.col("c_custkey") % 50 == 7, "retired").otherwise("active"), maturity=F.coalesce(pick("c_custkey", 4, k0="settled", k1="proposed"), F.lit("working")), grounding=pick("c_custkey", 3, k0="inferred", k1="docs", k2="empirical"), attestation=F.when(F.col("c_custkey") % 11 == 0, "human").otherwise("agent")),
        nodes(t("supplier"), key("mem:s", "s_suppkey"), "memory", "constraint", F.col("s_name"), status=F.lit("active"), maturity=F.coalesce(pick("s_suppkey", 4, k0="settled", k1="proposed"), F.lit("working")), grounding=pick("s_suppkey", 3, k0="inferred", k1="docs", k2="empirical"), attestation=F.when(F.col("s_suppkey") % 11 == 0, "human").otherwise("agent")),
        nodes(t("orders"), key("task:o/", "o_orderkey"), "plan", "task", F.col("o_orderpriority"), state=F.when(F.col("o_orderstatus") == "F", "done").otherwise("todo")),
        nodes(parts, key("sym:part.py#p", "p_partkey"), "structure", "function", F.col("p_name"), content=F.col("content_hash")),
    ]
    edge = lambda df, relation, src, dst, anchor=none, pending=F.lit(False): df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), anchor.alias("anchor"), pending.alias("pending"))
    stale = F.when((F.col("p_partkey") % 50).isin(5, 8), F.sha2(F.concat(F.lit("stale"), F.col("p_partkey").cast("string")), 256)).otherwise(F.col("content_hash"))
    lines = t("lineitem")
    built = lines.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct().join(apart, "p_partkey")
    held = lines.filter("l_partkey % 4 = 0").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct().join(apart, "p_partkey")
    orders, customer = t("orders"), t("customer")
    total = parts.agg(F.count("*").alias("n"))
    with_n = parts.select("p_partkey").crossJoin(F.broadcast(total))  # one row
    next_order = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"))
    prev_customer = customer.select((F.col("c_custkey") + 1).alias("c_custkey"))
    all_edges = [
        edge(built, "implements", key("task:o/", "l_orderkey"), key("sym:part.py#p", "p_partkey"), stale),
        edge(orders.join(customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey")), "tracks", key("task:o/", "o_orderkey"), key("int:n", "c_nationkey")),
        edge(customer, "serves", key("mem:c", "c_custkey"), key("int:n", "c_nationkey")),
        edge(t("nation"), "serves", key("int:n", "n_nationkey"), key("int:r", "n_regionkey")),
        edge(held, "concerns", key("mem:s", "l_suppkey"), key("sym:part.py#p", "p_partkey"), stale),
        edge(with_n.filter("p_partkey <> (p_partkey * 7 + 1) % n"), "calls", key("sym:part.py#p", "p_partkey"), F.concat(F.lit("sym:part.py#p"), F.expr("cast((p_partkey * 7 + 1) % n as string)"))),
        edge(parts.filter("p_partkey % 10 <> 0"), "contains", F.concat(F.lit("sym:part.py#p"), F.expr("cast(p_partkey div 10 * 10 as string)")), key("sym:part.py#p", "p_partkey")),
        edge(orders.filter("o_orderkey % 5 = 0").join(next_order.hint("merge"), "o_orderkey", "left_semi"), "requires", key("task:o/", "o_orderkey"), F.concat(F.lit("task:o/"), F.expr("cast(o_orderkey + 1 as string)"))),
        edge(customer.filter("c_custkey % 10 = 3").join(prev_customer.hint("merge"), "c_custkey", "left_semi"), "supersedes", key("mem:c", "c_custkey"), F.concat(F.lit("mem:c"), F.expr("cast(c_custkey - 1 as string)")), pending=F.col("c_custkey") % 20 == 13),
    ]
    lost = orders.filter("o_orderkey % 100 in (7, 8, 9)").crossJoin(F.broadcast(total))
    lost = lost.withColumn("p_partkey", F.expr("case when o_orderkey % 100 = 7 then (o_orderkey % n) div 3 * 3 else o_orderkey % n end")).join(apart, "p_partkey", "left")
    dangling = lost.select(key("task:o/", "o_orderkey").alias("src"), F.lit("implements").alias("relation"), key("sym:old.py#p", "o_orderkey").alias("target"), F.when(F.col("o_orderkey") % 100 == 8, F.sha2(F.lit("gone"), 256)).otherwise(F.col("content_hash")).alias("anchor"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return Graph(union(all_nodes), union(all_edges), dangling)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as stored assertions; each user is a project of its own for the hash chain."""
    return as_log(read(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("project"),
        F.col("event_id").alias("seq"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("id"),
        F.floor(F.col("event_id") / 7).cast("long").alias("session"),
        (F.col("user_id") % 5).alias("actor"),
        F.col("event_type").alias("family"),
        F.col("props").alias("body"),
    )


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as assertions with hashed ids: parents are the documents of half and of a third of the number, some pairs have each other, every fourth
    has none; every third document revises one of 40 locators, and each supersedes the node of half its number."""
    n = F.col("doc_id")
    named = lambda x: F.substring(F.sha2(F.concat(F.lit("a"), x.cast("string")), 256), 1, 12)
    at = lambda x: F.when(x % 3 == 0, F.concat(F.lit("int:l"), (x % 40).cast("string")))
    part = lambda k: F.floor(n / k).cast("long")
    edge = F.struct(F.lit("supersedes").alias("relation"), F.coalesce(at(part(2)), named(part(2))).alias("target"), (n % 5 == 0).alias("pending"))
    label, lang = F.struct(F.lit("label").alias("key"), F.col("source").alias("value")), F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value"))
    none = F.array().cast("array<string>")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        named(n).alias("id"),
        at(n).alias("locator"),
        F.when(n % 3 == 0, "intent").when(n % 3 == 1, "memory").otherwise("resolution").alias("family"),
        F.map_from_entries(F.when(n % 2 == 0, F.array(label, lang)).otherwise(F.array(label))).alias("attrs"),
        none.alias("provenance"),
        none.alias("scope"),
        F.when(n > 0, F.array(edge)).alias("edges"),
        F.when(n % 97 == 50, F.array(named(n + 1))).when(n % 97 == 51, F.array(named(n - 1))).when((n > 0) & (n % 4 != 3), F.array(named(part(2)), named(part(3)))).otherwise(none).alias("parents"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("anchor"), F.col("embedding").alias("vec"))

"""Queries of the graph engine over the driver's tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS
from graphloom.functions import scores, text
from graphloom.model import COMPOSE, SIGNATURES
from graphloom.operators import assertions as A
from graphloom.operators import beliefs, context, drift, exchange, log, nesting, overlay, retrieval, suggest, vector_index
from graphloom.operators import graph as G
from graphloom.sources import tables
from graphloom.streaming import state
from graphloom.tables import apart, checkpoint_dir, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The topic that the retrieval queries ask for, the walk's starts, and the clock of the recency queries.
TOPIC = ["the", "tion", "her", "zz"]
SEEDS = ["sym:part.py#p100", "int:n3", "task:o/70"]
START_PART, START_TASK = "sym:part.py#p100", "task:o/70"
NOW = 1_800_000_000
SIMILAR = 0.3


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{graph}", GRAPH).replace("{drift}", DRIFT).replace("{log}", LOG)
        return f

    return register


GRAPH = """
part_hash AS (SELECT p_partkey, p_name, sha256(concat_ws('|', p_brand, p_type, CAST(p_size AS VARCHAR)) || CASE WHEN p_partkey % 3 = 0 THEN '|' || p_partkey ELSE '' END) AS content_hash FROM part),
nodes AS (
  SELECT 'int:r' || r_regionkey AS node_id, 'intent' AS family, 'goal' AS kind, r_name AS label, 'active' AS status, NULL AS state, NULL AS maturity, NULL AS grounding, NULL AS attestation, NULL AS content_hash FROM region
  UNION ALL SELECT 'int:n' || n_nationkey, 'intent', 'requirement', n_name, CASE WHEN n_nationkey % 7 = 3 THEN 'archived' WHEN n_nationkey % 5 = 1 THEN 'satisfied' ELSE 'active' END, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'mem:c' || c_custkey, 'memory', 'decision', c_name, CASE WHEN c_custkey % 50 = 7 THEN 'retired' ELSE 'active' END, NULL, CASE c_custkey % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'proposed' ELSE 'working' END, CASE c_custkey % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'docs' ELSE 'empirical' END, CASE WHEN c_custkey % 11 = 0 THEN 'human' ELSE 'agent' END, NULL FROM customer
  UNION ALL SELECT 'mem:s' || s_suppkey, 'memory', 'constraint', s_name, 'active', NULL, CASE s_suppkey % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'proposed' ELSE 'working' END, CASE s_suppkey % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'docs' ELSE 'empirical' END, CASE WHEN s_suppkey % 11 = 0 THEN 'human' ELSE 'agent' END, NULL FROM supplier
  UNION ALL SELECT 'task:o/' || o_orderkey, 'plan', 'task', o_orderpriority, NULL, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'sym:part.py#p' || p_partkey, 'structure', 'function', p_name, NULL, NULL, NULL, NULL, NULL, content_hash FROM part_hash),
anchors AS (SELECT p_partkey, CASE WHEN p_partkey % 50 IN (5, 8) THEN sha256('stale' || p_partkey) ELSE content_hash END AS anchor FROM part_hash),
np AS (SELECT count(*) AS n FROM part),
edges AS (
  SELECT DISTINCT 'task:o/' || l_orderkey AS src, 'sym:part.py#p' || l_partkey AS dst, 'implements' AS relation, anchor, false AS pending FROM lineitem JOIN anchors ON p_partkey = l_partkey
  UNION ALL SELECT 'task:o/' || o_orderkey, 'int:n' || c_nationkey, 'tracks', NULL, false FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'mem:c' || c_custkey, 'int:n' || c_nationkey, 'serves', NULL, false FROM customer
  UNION ALL SELECT 'int:n' || n_nationkey, 'int:r' || n_regionkey, 'serves', NULL, false FROM nation
  UNION ALL SELECT DISTINCT 'mem:s' || l_suppkey, 'sym:part.py#p' || l_partkey, 'concerns', anchor, false FROM lineitem JOIN anchors ON p_partkey = l_partkey WHERE l_partkey % 4 = 0
  UNION ALL SELECT 'sym:part.py#p' || p_partkey, 'sym:part.py#p' || ((p_partkey * 7 + 1) % n), 'calls', NULL, false FROM part, np WHERE p_partkey <> (p_partkey * 7 + 1) % n
  UNION ALL SELECT 'sym:part.py#p' || (p_partkey // 10 * 10), 'sym:part.py#p' || p_partkey, 'contains', NULL, false FROM part WHERE p_partkey % 10 <> 0
  UNION ALL SELECT 'task:o/' || o_orderkey, 'task:o/' || (o_orderkey + 1), 'requires', NULL, false FROM orders o WHERE o_orderkey % 5 = 0 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey + 1)
  UNION ALL SELECT 'mem:c' || c_custkey, 'mem:c' || (c_custkey - 1), 'supersedes', NULL, c_custkey % 20 = 13 FROM customer c WHERE c_custkey % 10 = 3 AND EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey = c.c_custkey - 1)),
dangling AS (
  SELECT 'task:o/' || o_orderkey AS src, 'implements' AS relation, 'sym:old.py#p' || o_orderkey AS target, CASE WHEN o_orderkey % 100 = 8 THEN sha256('gone') ELSE content_hash END AS anchor
  FROM orders CROSS JOIN np LEFT JOIN part_hash ON p_partkey = CASE WHEN o_orderkey % 100 = 7 THEN (o_orderkey % n) // 3 * 3 ELSE o_orderkey % n END
  WHERE o_orderkey % 100 IN (7, 8, 9))"""
DRIFT = GRAPH + """,
oldsrc AS (SELECT DISTINCT dst AS src FROM edges WHERE relation = 'supersedes'),
soft AS (SELECT e.src, e.dst, e.relation FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.relation IN ('implements', 'concerns', 'grounded_by') AND e.anchor IS NOT NULL AND n.content_hash IS NOT NULL AND e.anchor <> n.content_hash AND e.src NOT IN (SELECT src FROM oldsrc)),
uniq AS (SELECT content_hash, min(node_id) AS now FROM nodes WHERE family = 'structure' GROUP BY content_hash HAVING count(*) = 1),
ren AS (SELECT d.src, d.relation, d.target AS was, u.now FROM dangling d JOIN uniq u ON u.content_hash = d.anchor),
hard AS (SELECT d.src, d.target AS dst, d.relation FROM dangling d WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.src = d.src AND r.was = d.target) AND d.src NOT IN (SELECT src FROM oldsrc)),
items AS (SELECT *, 'soft' AS kind FROM soft UNION ALL SELECT *, 'hard' FROM hard UNION ALL SELECT src, now, relation, 'renamed' FROM ren),
done AS (SELECT node_id AS src FROM nodes WHERE state = 'done'),
surf AS (SELECT * FROM items WHERE kind <> 'renamed' AND NOT (relation = 'implements' AND src IN (SELECT src FROM done)))"""
LOG = "log AS (SELECT user_id AS project, event_id AS seq, event_type || ':' || user_id AS id, event_id // 7 AS session, user_id % 5 AS actor, event_type AS family, props AS body FROM events)"
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
_WALKED = """
last AS (SELECT src, dst, max(relation) AS relation FROM edges GROUP BY src, dst),
ways AS (SELECT src, dst, relation, 0 AS way FROM last UNION ALL SELECT dst, src, relation, 1 FROM last),
pairs AS (SELECT DISTINCT src, dst FROM edges),
deg AS (SELECT n.node_id, coalesce(c, 0) AS degree FROM nodes n LEFT JOIN (SELECT x, count(*) AS c FROM (SELECT src AS x FROM pairs UNION ALL SELECT dst FROM pairs) GROUP BY x) ON x = n.node_id),
ordered AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg),
cut AS (SELECT greatest(50, (SELECT degree FROM ordered WHERE i = least(n - 1, CAST(round_even((n - 1) * 0.99, 0) AS BIGINT)))) AS cut),
hub AS (SELECT node_id, degree FROM deg, cut WHERE degree >= cut)"""


@query("WITH {graph}, sig(relation, side, tag) AS (VALUES " + _VALUES([(r, s, t) for r, (a, b) in SIGNATURES.items() for s, ts in (("s", a), ("t", b)) for t in ts]) + """)
SELECT e.src, e.dst, e.relation FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst
WHERE e.relation IN (SELECT relation FROM sig) AND NOT (EXISTS (SELECT 1 FROM sig WHERE sig.relation = e.relation AND side = 's' AND tag IN (a.family, a.family || '/' || a.kind))
  AND EXISTS (SELECT 1 FROM sig WHERE sig.relation = e.relation AND side = 't' AND tag IN (b.family, b.family || '/' || b.kind)))""")
def well_typed_audit(spark, sf_dir):
    return G.mistyped(tables.graph(spark, sf_dir))


@query("WITH {graph}," + _WALKED + " SELECT node_id, degree FROM hub")
def degree_hubs(spark, sf_dir):
    return G.hubs(tables.graph(spark, sf_dir))


@query("""WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT n_chars FROM o WHERE i = least(n - 1, CAST(round_even((n - 1) * 0.9, 0) AS BIGINT))""")
def percentile_nearest(spark, sf_dir):
    return G.nearest_percentile(tables.read(spark, sf_dir, "documents"), "n_chars", 90)


@query("WITH {graph} SELECT n.node_id, count(e.src) AS refs FROM nodes n LEFT JOIN edges e ON e.dst = n.node_id AND e.relation IN ('implements', 'tracks', 'serves', 'concerns', 'references') GROUP BY n.node_id")
def refs_in(spark, sf_dir):
    return G.refs_in(tables.graph(spark, sf_dir))


@query("""WITH {graph}, s AS (SELECT * FROM edges WHERE relation = 'supersedes' AND NOT pending)
SELECT node_id, (SELECT count(*) FROM s WHERE dst = node_id) AS superseded_in, (SELECT count(*) FROM s WHERE src = node_id) AS supersedes_out, (SELECT count(*) FROM s WHERE dst = node_id) = 0 AS accepted FROM nodes""")
def supersede_counters(spark, sf_dir):
    return G.supersession(tables.graph(spark, sf_dir))


@query("WITH {graph} SELECT src, dst, max(relation) AS relation FROM edges GROUP BY src, dst")
def collapse_edges(spark, sf_dir):
    return G.collapse_edges(tables.graph(spark, sf_dir).edges, F.col("relation"))


@query("WITH {graph}," + _WALKED + ", seed(node_id, place) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(SEEDS)) + """),
l0 AS (SELECT s.node_id, 0 AS hops, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS relation, row_number() OVER (ORDER BY place) - 1 AS place FROM seed s JOIN nodes USING (node_id)),
c1 AS (SELECT b.dst, min({'p': l.place, 's': b.src, 'w': b.way, 'r': b.relation}) AS m FROM l0 l JOIN ways b ON b.src = l.node_id WHERE b.dst NOT IN (SELECT node_id FROM l0) GROUP BY b.dst),
n1 AS (SELECT dst, m, row_number() OVER (ORDER BY m.p, dst) + (SELECT count(*) FROM l0) AS k FROM c1),
l1 AS (SELECT * FROM l0 UNION ALL SELECT dst, 1, m.s, m.r, k - 1 FROM n1 WHERE k <= 60),
c2 AS (SELECT b.dst, min({'p': l.place, 's': b.src, 'w': b.way, 'r': b.relation}) AS m FROM l1 l JOIN ways b ON b.src = l.node_id WHERE l.hops = 1 AND l.node_id NOT IN (SELECT node_id FROM hub) AND b.dst NOT IN (SELECT node_id FROM l1) GROUP BY b.dst),
n2 AS (SELECT dst, m, row_number() OVER (ORDER BY m.p, dst) + (SELECT count(*) FROM l1) AS k FROM c2)
SELECT node_id, hops, parent, relation, place FROM l1 UNION ALL SELECT dst, 2, m.s, m.r, k - 1 FROM n2 WHERE k <= 60""")
def bfs_hops_parent(spark, sf_dir):
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(SEEDS)], "node_id string, place int")
    return G.traverse(tables.graph(spark, sf_dir), seeds)


def _reach_sql(start: str, reverse: bool, depth: int, select: str) -> str:
    hop = "e.dst AS here, e.src AS nxt" if reverse else "e.src AS here, e.dst AS nxt"
    rels = "list_concat([h.relation], w.rels)" if reverse else "list_concat(w.rels, [h.relation])"
    composed = " ".join(f"WHEN '{a} {b}' THEN '{c}'" for (a, b), c in COMPOSE.items())
    return (
        "WITH RECURSIVE {graph}, sig(relation, side, tag) AS (VALUES "
        + _VALUES([(r, s, t) for r, (a, b) in SIGNATURES.items() for s, ts in (("s", a), ("t", b)) for t in ts])
        + f"""),
good AS (SELECT DISTINCT {hop}, e.relation FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst
  WHERE EXISTS (SELECT 1 FROM sig WHERE sig.relation = e.relation AND side = 's' AND tag IN (a.family, a.family || '/' || a.kind)) AND EXISTS (SELECT 1 FROM sig WHERE sig.relation = e.relation AND side = 't' AND tag IN (b.family, b.family || '/' || b.kind))),
w AS (SELECT '{start}' AS here, CAST([] AS VARCHAR[]) AS rels, ['{start}'] AS path, '' AS relation
  UNION ALL
  SELECT * FROM (SELECT h.nxt, {rels} AS r, list_append(w.path, h.nxt), list_reduce({rels}, lambda a, b: CASE a || ' ' || b {composed} END) AS c
    FROM w JOIN good h ON h.here = w.here AND NOT list_contains(w.path, h.nxt) WHERE len(w.rels) < {depth}) WHERE c IS NOT NULL)
{select}"""
    )


_BEST = "SELECT '{s}' AS start, here AS target, relation, CASE WHEN min(len(rels)) = 1 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CAST(min(len(rels)) AS INTEGER) AS depth FROM w WHERE len(rels) > 0 {where} GROUP BY here, relation"


@query(_reach_sql(START_TASK, False, 6, _BEST.replace("{s}", START_TASK).replace("{where}", "")))
def reach_forward(spark, sf_dir):
    return G.reach(tables.graph(spark, sf_dir), spark.createDataFrame([(START_TASK,)], "node_id string"), False)


@query(_reach_sql(START_PART, True, 6, _BEST.replace("{s}", START_PART).replace("{where}", "")))
def reach_reverse(spark, sf_dir):
    return G.reach(tables.graph(spark, sf_dir), spark.createDataFrame([(START_PART,)], "node_id string"), True)


@query(_reach_sql(START_PART, True, 6, _BEST.replace("{s}", START_PART).replace("{where}", "AND here IN (SELECT node_id FROM nodes WHERE family IN ('plan', 'memory', 'intent'))")))
def blast_radius(spark, sf_dir):
    return G.blast_radius(tables.graph(spark, sf_dir), spark.createDataFrame([(START_PART,)], "node_id string"))


@query("WITH {graph}, cmp(a, b, c) AS (VALUES " + _VALUES([(*k, v) for k, v in COMPOSE.items()]) + """)
SELECT x.relation AS first, y.relation AS second, c AS relation, count(*) AS paths FROM edges x JOIN edges y ON y.src = x.dst LEFT JOIN cmp ON a = x.relation AND b = y.relation GROUP BY x.relation, y.relation, c""")
def compose_chain(spark, sf_dir):
    """The composed relation of all paths of two edges, by count."""
    e = tables.graph(spark, sf_dir).edges
    both = e.select("dst", F.col("relation").alias("first")).join(e.select(F.col("src").alias("dst"), F.col("relation").alias("second")), "dst")
    counted = both.groupBy("first", "second").agg(F.count("*").alias("paths"))
    return counted.select("first", "second", scores.compose_chain(F.array("first", "second")).alias("relation"), "paths")


@query("WITH {drift} SELECT * FROM soft")
def soft_drift(spark, sf_dir):
    return drift.soft(tables.graph(spark, sf_dir))


@query("WITH {drift} SELECT * FROM hard")
def hard_drift(spark, sf_dir):
    return drift.hard(tables.graph(spark, sf_dir))


@query("WITH {drift} SELECT * FROM ren")
def renames(spark, sf_dir):
    return drift.renames(tables.graph(spark, sf_dir))


@query("WITH {drift} SELECT * FROM surf")
def drift_surfaced(spark, sf_dir):
    return drift.surfaced(tables.graph(spark, sf_dir))


@query("WITH {drift} SELECT src, dst, kind FROM items WHERE kind <> 'renamed' AND relation = 'implements' AND src IN (SELECT src FROM done)")
def stale_completions(spark, sf_dir):
    return drift.stale_completions(tables.graph(spark, sf_dir))


@query("""WITH {drift}, o AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'hard' THEN 0 ELSE 1 END, src, dst, relation) AS i FROM surf)
SELECT string_agg(src || ' ' || dst, '; ' ORDER BY i) FILTER (i <= 4) AS shown, greatest(count(*) - 4, 0) AS more FROM o""")
def drift_cap(spark, sf_dir):
    return drift.capped(drift.surfaced(tables.graph(spark, sf_dir)), DEFAULTS.max_drift_lines)


@query("WITH {drift} SELECT src AS node_id FROM done WHERE src NOT IN (SELECT src FROM edges WHERE relation = 'implements') AND src NOT IN (SELECT src FROM dangling)")
def capture_gaps(spark, sf_dir):
    return drift.capture_gaps(tables.graph(spark, sf_dir))


@query("WITH {drift} SELECT node_id FROM nodes WHERE family = 'plan' AND state <> 'done' AND node_id IN (SELECT src FROM edges WHERE relation = 'implements') AND node_id NOT IN (SELECT src FROM items WHERE relation = 'implements' AND kind <> 'renamed')")
def open_implemented(spark, sf_dir):
    return drift.open_implemented(tables.graph(spark, sf_dir))


@query("""WITH {drift}, even AS (SELECT 'task:o/' || o_orderkey AS src FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0),
kept AS (SELECT * FROM edges WHERE relation = 'implements' AND src NOT IN (SELECT src FROM even)),
sound AS (SELECT DISTINCT e.src FROM kept e WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.kind <> 'renamed' AND i.src = e.src AND i.dst = e.dst))
SELECT node_id FROM nodes WHERE family = 'intent' AND status = 'satisfied' AND node_id NOT IN (SELECT t.dst FROM edges t JOIN sound s ON s.src = t.src WHERE t.relation = 'tracks')""")
def verified_reconcile(spark, sf_dir):
    """The tasks of every other nation have lost their symbols."""
    g = tables.graph(spark, sf_dir)
    orders, customer = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").hint("merge")
    even = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.concat(F.lit("task:o/"), F.col("o_orderkey").cast("string")).alias("src"))
    built = F.col("relation") == "implements"
    kept = g.edges.filter(~built).unionByName(g.edges.filter(built).join(even.hint("merge"), "src", "left_anti"))
    return drift.verified_reconcile(G.Graph(g.nodes, kept, g.dangling), drift.items(g))  # drift on what is lost is no other task's, so the items of the whole graph do


@query("WITH {graph} SELECT src, dst FROM edges WHERE relation = 'supersedes' AND pending")
def pending_conflicts(spark, sf_dir):
    return drift.pending_conflicts(tables.graph(spark, sf_dir))


@query("""WITH {graph} SELECT t.dst AS node_id, count(DISTINCT i.dst) AS n, any_value(x.label) AS statement FROM edges i JOIN edges t ON t.src = i.src AND t.relation = 'tracks' JOIN nodes x ON x.node_id = t.dst
WHERE i.relation = 'implements' AND x.status <> 'archived' AND i.dst IN (SELECT node_id FROM nodes WHERE family = 'structure' AND label LIKE '%e%') GROUP BY t.dst""")
def proof_obligations(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return drift.proof_obligations(g, g.nodes.filter("family = 'structure' and label like '%e%'").select("node_id"))


@query("""WITH {drift} SELECT 'conflict' AS kind, src || '|' || dst AS key FROM edges WHERE relation = 'supersedes' AND pending
UNION ALL SELECT 'stale', src || '|' || dst FROM items WHERE kind <> 'renamed' AND relation = 'implements' AND src IN (SELECT src FROM done)
UNION ALL SELECT 'drift', kind || '|' || src || '|' || dst || '|' || relation FROM surf""")
def obligations(spark, sf_dir):
    return drift.obligations(tables.graph(spark, sf_dir))


@query("""WITH {graph}, sup AS (SELECT dst FROM edges WHERE relation = 'supersedes' AND NOT pending),
prem AS (SELECT 'mem:c' || c_custkey AS belief, unnest(['int:n' || c_nationkey, 'mem:c' || (c_custkey + 1)]) AS ref FROM customer)
SELECT belief, ref, CASE WHEN n.node_id IS NULL THEN false WHEN n.family = 'intent' THEN n.status <> 'archived' WHEN n.family = 'memory' THEN ref NOT IN (SELECT dst FROM sup) ELSE true END AS holds FROM prem LEFT JOIN nodes n ON n.node_id = ref""")
def premise_applicability(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    c = tables.read(spark, sf_dir, "customer")
    mem = lambda k: F.concat(F.lit("mem:c"), (F.col("c_custkey") + k).cast("string"))
    premises = c.select(mem(0).alias("belief"), F.explode(F.array(F.concat(F.lit("int:n"), F.col("c_nationkey").cast("string")), mem(1))).alias("ref"))
    return drift.premise_holds(g, premises, G.supersession(g))


@query("""WITH {drift}, sup AS (SELECT DISTINCT dst FROM edges WHERE relation = 'supersedes' AND NOT pending)
SELECT count(*) FILTER (family = 'structure' AND kind NOT IN ('file', 'module')) AS symbols, count(*) FILTER (family = 'intent') AS intents, count(*) FILTER (family = 'plan' AND kind = 'task') AS tasks,
  count(*) FILTER (family = 'plan' AND state <> 'done') AS open_tasks, count(*) FILTER (family = 'memory' AND status = 'active' AND node_id NOT IN (SELECT dst FROM sup)) AS decisions,
  (SELECT count(*) FROM surf) AS drift, (SELECT count(*) FROM items WHERE kind <> 'renamed' AND relation = 'implements' AND src IN (SELECT src FROM done)) AS stale,
  (SELECT count(*) FROM edges WHERE relation = 'supersedes' AND pending) AS conflicts FROM nodes""")
def status_summary(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return drift.status(g, G.supersession(g))


@query("""WITH {graph}, t AS (SELECT node_id, CASE WHEN attestation = 'human' THEN 0 WHEN family = 'intent' THEN 1 WHEN family = 'memory' AND grounding = 'empirical' THEN 2 WHEN family = 'memory' AND kind IN ('decision', 'constraint') THEN 3 WHEN family = 'plan' THEN 4 WHEN family = 'structure' THEN 5 ELSE 6 END AS r FROM nodes)
SELECT e.src AS left_id, e.dst AS right_id, CASE WHEN a.r < b.r THEN e.src WHEN b.r < a.r THEN e.dst END AS dominant FROM edges e JOIN t a ON a.node_id = e.src JOIN t b ON b.node_id = e.dst WHERE e.relation = 'supersedes'""")
def dominant_side(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return beliefs.dominant(g, g.edges.filter("relation = 'supersedes'").select(F.col("src").alias("left_id"), F.col("dst").alias("right_id")))


_NOMINATED = """SELECT DISTINCT 'mem:s' || least(a.l_suppkey, b.l_suppkey) AS l, 'mem:s' || greatest(a.l_suppkey, b.l_suppkey) AS r FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_suppkey <> b.l_suppkey"""


def _nominated_pairs(spark, sf_dir):
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("other"))
    mem = lambda c: F.concat(F.lit("mem:s"), c.cast("string"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("l_suppkey <> other").select(F.least("l_suppkey", "other").alias("a"), F.greatest("l_suppkey", "other").alias("b")).distinct()
    return pairs.select(mem(F.col("a")).alias("left_id"), mem(F.col("b")).alias("right_id"))


@query("WITH {graph}, nom AS (" + _NOMINATED + """) SELECT l AS left_id, r AS right_id, min(x.dst) AS anchor FROM nom JOIN edges x ON x.src = l AND x.relation = 'concerns' JOIN edges y ON y.src = r AND y.relation = 'concerns' AND y.dst = x.dst GROUP BY l, r""")
def nominated_conflicts(spark, sf_dir):
    return beliefs.shared_anchor(tables.graph(spark, sf_dir), _nominated_pairs(spark, sf_dir))


@query("""WITH {graph}, s AS (SELECT * FROM edges WHERE relation = 'supersedes' AND NOT pending), r AS (SELECT dst, count(*) AS refs FROM edges WHERE relation IN ('implements', 'tracks', 'serves', 'concerns', 'references') GROUP BY dst),
g AS (SELECT node_id, CASE WHEN node_id IN (SELECT dst FROM s) AND coalesce(refs, 0) = 0 THEN 'superseded-churn' WHEN maturity = 'proposed' AND CAST(substr(node_id, 6) AS BIGINT) % 60 >= 30 AND coalesce(refs, 0) = 0 THEN 'abandoned-proposed' END AS reason FROM nodes LEFT JOIN r ON dst = node_id WHERE family = 'memory')
SELECT * FROM g WHERE reason IS NOT NULL""")
def gc_classify(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    age = g.nodes.filter("family = 'memory'").select("node_id", (F.substring("node_id", 6, 20).cast("long") % 60).alias("survival"))
    return beliefs.classify_gc(g, age, DEFAULTS.proposed_ttl)


@query("""WITH {graph}, u AS (SELECT 'mem:c' || user_id AS node_id, count(*) * 0.25 AS upholds, count(*) AS survival FROM events WHERE event_type = 'click' GROUP BY user_id), s AS (SELECT DISTINCT dst FROM edges WHERE relation = 'supersedes' AND NOT pending)
SELECT n.node_id, CASE WHEN maturity = 'proposed' AND coalesce(upholds, 0) < 1 THEN 'proposed' WHEN coalesce(upholds, 0) >= 3 AND n.node_id NOT IN (SELECT dst FROM s) AND coalesce(survival, 0) >= 0 THEN 'settled' ELSE 'working' END AS verdict FROM nodes n LEFT JOIN u ON u.node_id = n.node_id WHERE family = 'memory'""")
def maturity_verdict(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    up = tables.read(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.concat(F.lit("mem:c"), F.col("user_id").cast("string")).alias("node_id")).agg((F.count("*") * 0.25).alias("upholds"), F.count("*").alias("survival"))
    all_ = g.nodes.filter("family = 'memory'").select("node_id", "maturity").join(G.supersession(g), "node_id").join(up, "node_id", "left").na.fill(0, ["upholds", "survival"])
    return all_.select("node_id", scores.maturity_verdict(F.col("maturity"), F.col("upholds"), F.col("superseded_in"), F.col("survival"), F.lit(True)).alias("verdict"))


@query(f"""WITH {{graph}}, r AS (SELECT dst, count(*) AS refs FROM edges WHERE relation IN ('implements', 'tracks', 'serves', 'concerns', 'references') GROUP BY dst), seen AS (SELECT 'mem:c' || user_id AS node_id, max(epoch(ts)) AS last_seen FROM events GROUP BY user_id), s AS (SELECT DISTINCT dst FROM edges WHERE relation = 'supersedes' AND NOT pending)
SELECT n.node_id, round(ln(1 + coalesce(refs, 0)) + CASE WHEN last_seen IS NULL THEN 0.0 ELSE pow(0.5, greatest(({NOW} - CAST(last_seen AS BIGINT)) / 86400.0, 0.0) / 14.0) END + CASE WHEN maturity = 'settled' THEN 1 ELSE 0 END - CASE WHEN maturity = 'proposed' THEN 3 ELSE 0 END - CASE WHEN n.node_id IN (SELECT dst FROM s) THEN 1 ELSE 0 END, 6) AS relevance
FROM nodes n LEFT JOIN r ON r.dst = n.node_id LEFT JOIN seen ON seen.node_id = n.node_id WHERE family = 'memory'""")
def relevance_prior(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    seen = tables.read(spark, sf_dir, "events").groupBy(F.concat(F.lit("mem:c"), F.col("user_id").cast("string")).alias("node_id")).agg(F.max(epoch).alias("last_seen"))
    all_ = g.nodes.filter("family = 'memory'").select("node_id", "maturity").join(G.refs_in(g), "node_id").join(G.supersession(g), "node_id").join(seen, "node_id", "left")
    recent = scores.recency(F.col("last_seen"), F.lit(NOW))
    return all_.select("node_id", F.round(scores.relevance(F.col("refs"), recent, F.col("maturity"), F.col("superseded_in")), 6).alias("relevance"))


@query("""WITH {graph}, o AS (SELECT node_id, 0 AS p, label, 'ours' AS origin FROM nodes WHERE family = 'intent' UNION ALL SELECT node_id, 1, upper(label), 'theirs' FROM nodes WHERE family IN ('intent', 'memory'))
SELECT node_id, arg_min(label, p) AS label, arg_min(origin, p) AS origin FROM o GROUP BY node_id""")
def union_merge(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    cut = lambda n, up, origin: G.Graph(n.select("node_id", (F.upper("label") if up else F.col("label")).alias("label"), F.lit(origin).alias("origin")), g.edges.select("src", "dst", "relation", "pending"), g.dangling)
    nodes, _ = G.union_merge(cut(g.nodes.filter("family = 'intent'"), False, "ours"), cut(g.nodes.filter("family in ('intent', 'memory')"), True, "theirs"))
    return nodes


_TERMS = r"""pre AS (SELECT 'doc:' || doc_id AS node_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS ts FROM documents),
term AS (SELECT DISTINCT node_id, lower(unnest(ts)) AS term FROM pre),
idf AS (SELECT term, count(*) AS df, ln(1 + (SELECT greatest(count(*), 1) FROM documents) / count(*)) AS idf FROM term GROUP BY term)"""
_SCORES = _TERMS + ", q(i, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(TOPIC)) + """),
w AS (SELECT i, q, coalesce(idf, ln(2)) AS w FROM q LEFT JOIN idf ON idf.term = q),
hit AS (SELECT node_id, i, max(w) AS w, max(CASE WHEN term = q THEN 1.0 WHEN starts_with(term, q) OR starts_with(q, term) THEN 0.6 WHEN contains(term, q) THEN 0.3 END) AS how FROM term, w GROUP BY node_id, i),
score AS (SELECT node_id, round(sum(w * how), 6) AS score FROM hit WHERE how IS NOT NULL GROUP BY node_id)"""


def _documents(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), "text")


def _scores(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    terms = retrieval.postings(docs, "text")
    return retrieval.match_scores(terms, retrieval.idf(terms, docs), TOPIC).select("node_id", F.round("score", 6).alias("score"))


@query("WITH " + _TERMS + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def terms_df_idf(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return retrieval.idf(retrieval.postings(docs, "text"), docs).select("term", "df", F.round("idf", 6).alias("idf"))


@query("WITH " + _SCORES + " SELECT * FROM score")
def match_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("WITH " + _SCORES + """, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS place FROM score ORDER BY score DESC, node_id LIMIT 5),
d AS (SELECT *, CASE WHEN score < 0.5 * lag(score) OVER (ORDER BY place) THEN 1 ELSE 0 END AS b FROM top), c AS (SELECT *, max(b) OVER (ORDER BY place) AS cut FROM d)
SELECT node_id, score, CAST(place AS INTEGER) AS place FROM c WHERE cut = 0""")
def seed_cutoff(spark, sf_dir):
    return retrieval.seeds(_scores(spark, sf_dir))


_FUSED = _SCORES + """, x AS (SELECT 'doc:' || d.doc_id AS node_id, d.doc_id % 3 AS hops, ln(1 + n_chars) AS relevance, coalesce(score, 0) AS match FROM documents d LEFT JOIN score s ON s.node_id = 'doc:' || d.doc_id),
m AS (SELECT min(match) AS a, max(match) AS b, min(1 / (1.0 + hops)) AS c, max(1 / (1.0 + hops)) AS d, min(relevance) AS e, max(relevance) AS f FROM x),
fin AS (SELECT node_id, round(0.5 * CASE WHEN b - a < 1e-12 THEN 0 ELSE (match - a) / (b - a) END + 0.3 * CASE WHEN d - c < 1e-12 THEN 0 ELSE (1 / (1.0 + hops) - c) / (d - c) END + 0.2 * CASE WHEN f - e < 1e-12 THEN 0 ELSE (relevance - e) / (f - e) END, 6) AS final FROM x, m),
ranked AS (SELECT node_id, final, CAST(row_number() OVER (ORDER BY final DESC, node_id) AS INTEGER) AS place FROM fin)"""


def _ranked(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), (F.col("doc_id") % 3).alias("hops"), F.log(1.0 + F.col("n_chars")).alias("relevance"))
    return retrieval.rank(docs.join(_scores(spark, sf_dir).withColumnRenamed("score", "match"), "node_id", "left"))


@query("WITH " + _FUSED + " SELECT * FROM ranked WHERE place <= 60")
def fusion_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query("WITH RECURSIVE " + _FUSED + """, l AS (SELECT r.place, r.node_id, CAST(d.n_chars // 3 AS BIGINT) AS cost FROM ranked r JOIN documents d ON 'doc:' || d.doc_id = r.node_id WHERE r.place <= 60),
f AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS used, false AS kept UNION ALL SELECT f.i + 1, CASE WHEN used + cost <= 4000 THEN used + cost ELSE used END, used + cost <= 4000 FROM f JOIN l ON l.place = f.i + 1)
SELECT l.place, l.node_id, l.cost FROM f JOIN l ON l.place = f.i WHERE kept""")
def budget_fill(spark, sf_dir):
    size = tables.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.floor(F.col("n_chars") / 3).cast("long").alias("cost"))
    return retrieval.fill_budget(_ranked(spark, sf_dir).join(size, "node_id").select("place", "node_id", "cost"), DEFAULTS.query_budget)


@query("""WITH {graph}, s AS (SELECT DISTINCT dst FROM edges WHERE relation = 'supersedes' AND NOT pending), r AS (SELECT dst, count(*) AS refs FROM edges WHERE relation IN ('implements', 'tracks', 'serves', 'concerns', 'references') GROUP BY dst)
SELECT node_id, label AS title, coalesce(refs, 0) AS refs FROM nodes LEFT JOIN r ON dst = node_id WHERE family = 'memory' AND status = 'active' AND maturity <> 'proposed' AND node_id NOT IN (SELECT dst FROM s) ORDER BY coalesce(refs, 0) DESC, node_id LIMIT 15""")
def manifest_titles(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    live = beliefs.live_memories(g).filter("maturity <> 'proposed'").join(G.refs_in(g), "node_id")
    return live.orderBy(F.desc("refs"), "node_id").limit(DEFAULTS.manifest_titles).select("node_id", text.title(F.col("label")).alias("title"), "refs")


_VEC = "v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS anchor, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


@query("WITH " + _VEC + """, c AS (SELECT q.id AS query, v.id, round(list_dot_product(v.vec, q.vec), 6) AS cosine FROM v, v q WHERE q.id % 50 = 0 AND v.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 10""")
def vector_topk(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return retrieval.vector_topk(v, v.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec")), 10)


@query("WITH " + _VEC + f" SELECT a.id AS left_id, b.id AS right_id, a.anchor, round(list_dot_product(a.vec, b.vec), 6) AS cosine FROM v a JOIN v b ON a.anchor = b.anchor AND a.id < b.id WHERE round(list_dot_product(a.vec, b.vec), 6) >= {SIMILAR}")
def conflict_sweep(spark, sf_dir):
    return retrieval.similar_pairs(tables.vectors(spark, sf_dir), SIMILAR)


@query("WITH " + _VEC + f""", p AS (SELECT a.id, b.id AS twin, round(list_dot_product(a.vec, b.vec), 6) AS cosine FROM v a JOIN v b ON a.anchor = b.anchor AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, twin) AS i FROM p WHERE cosine >= {SIMILAR})
SELECT id, twin, cosine FROM r WHERE i = 1""")
def near_dup_guard(spark, sf_dir):
    return retrieval.nearest_on_anchor(tables.vectors(spark, sf_dir), SIMILAR)


@query("""WITH {log}, a AS (SELECT id, actor, min(seq) AS s FROM log GROUP BY id, actor)
SELECT id, arg_min(body, seq) AS body, min(seq) AS first_seq, count(*) AS events, (SELECT string_agg(CAST(actor AS VARCHAR), ',' ORDER BY s) FROM a WHERE a.id = log.id) AS actors FROM log GROUP BY id""")
def collapse_log(spark, sf_dir):
    return log.collapse(tables.log(spark, sf_dir))


@query("WITH {log}, r AS (SELECT *, row_number() OVER (PARTITION BY project, id, body ORDER BY seq) AS i FROM log) SELECT project, id, body, seq, session, actor, family FROM r WHERE i = 1")
def event_dedup(spark, sf_dir):
    return log.first_by_key(tables.log(spark, sf_dir), ["project", "id", "body"])


@query("WITH {log} SELECT id, min(seq) AS seq, CAST(arg_min(actor, seq) AS VARCHAR) AS actor FROM log GROUP BY id")
def landings(spark, sf_dir):
    return log.landings(tables.log(spark, sf_dir))


@query("WITH {log} SELECT CAST(arg_max(actor, seq) AS VARCHAR) AS actor FROM log WHERE family = 'click'")
def own_actor(spark, sf_dir):
    events = tables.log(spark, sf_dir)
    return log.own_actor(events, events.filter("family = 'click'").select("id").distinct())


@query("""WITH {log}, w AS (SELECT id, seq, count(*) OVER (ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - count(*) OVER (PARTITION BY session ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS survival FROM log)
SELECT id, arg_min(survival, seq) AS survival FROM w GROUP BY id""")
def log_survival(spark, sf_dir):
    return log.survival(tables.log(spark, sf_dir))


@query("""WITH {log}, l AS (SELECT id, min(seq) AS seq, CAST(arg_min(actor, seq) AS VARCHAR) AS actor FROM log GROUP BY id),
c AS (SELECT DISTINCT 'click:' || user_id AS left_id, 'purchase:' || user_id AS right_id FROM events)
SELECT left_id, right_id, coalesce(CASE WHEN coalesce(r.seq, -1) > coalesce(a.seq, -1) THEN r.actor ELSE a.actor END, 'unattributed') AS owner FROM c LEFT JOIN l a ON a.id = left_id LEFT JOIN l r ON r.id = right_id""")
def assign_responsibility(spark, sf_dir):
    user = F.col("user_id").cast("string")
    pairs = tables.read(spark, sf_dir, "events").select(F.concat(F.lit("click:"), user).alias("left_id"), F.concat(F.lit("purchase:"), user).alias("right_id")).distinct()
    return log.assign(pairs, log.landings(tables.log(spark, sf_dir)))


@query("""WITH {log}, live AS (SELECT family, actor, max(seq) AS live_seq FROM log WHERE seq % 3 = 0 GROUP BY family, actor)
SELECT id FROM (SELECT l.id, coalesce(l.seq < live_seq, false) AS old FROM log l LEFT JOIN live ON live.family = l.family AND live.actor = l.actor WHERE l.seq % 3 <> 0) GROUP BY id HAVING bool_and(old)""")
def divergence_history(spark, sf_dir):
    events = tables.log(spark, sf_dir).withColumnRenamed("family", "locator")
    return log.history(events.filter("seq % 3 <> 0"), events.filter("seq % 3 = 0"))


@query("""WITH RECURSIVE {log}, k AS (SELECT *, sha256(project || chr(0) || id || chr(0) || body) AS event_key, row_number() OVER (PARTITION BY project ORDER BY seq) AS i FROM log),
c AS (SELECT project, 0 AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS prev_hash, repeat('0', 64) AS entry_hash UNION ALL (SELECT k.project, k.i, k.seq, c.entry_hash, sha256(c.entry_hash || chr(0) || k.event_key) FROM c JOIN k ON k.project = c.project AND k.i = c.i + 1))
SELECT project, seq, prev_hash, entry_hash FROM c WHERE i > 0""".replace("SELECT project, 0 AS i", "SELECT DISTINCT project, 0 AS i").replace("AS entry_hash UNION ALL", "AS entry_hash FROM log UNION ALL"))
def chain_build(spark, sf_dir):
    return log.build_chain(tables.log(spark, sf_dir)).select("project", "seq", "prev_hash", "entry_hash")


@query("""WITH {log}, t AS (SELECT project, seq, seq % 97 = 0 OR coalesce(lag(seq) OVER (PARTITION BY project ORDER BY seq) % 97 = 0, false) AS bad FROM log)
SELECT project, count(*) FILTER (bad) AS bad, min(seq) FILTER (bad) AS first_bad FROM t GROUP BY project""")
def hash_chain_verify(spark, sf_dir):
    """Every 97th entry is tampered with; it and the one after it do not follow."""
    chain = log.build_chain(tables.log(spark, sf_dir))
    return log.verify_chain(chain.withColumn("entry_hash", F.when(F.col("seq") % 97 == 0, "tampered").otherwise(F.col("entry_hash"))))


@query("""WITH {log}, e AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN '' ELSE family END AS family, CASE WHEN seq % 13 = 0 THEN NULL ELSE actor END AS actor, session, id, CASE WHEN seq % 17 = 0 THEN 'lost:' || seq WHEN seq % 2 = 0 THEN id END AS parent FROM log)
SELECT seq, array_to_string(list_filter([CASE WHEN family = '' THEN 'no family' END, CASE WHEN actor IS NULL THEN 'no actor' END, CASE WHEN parent LIKE 'lost:%' THEN 'unknown parent' END], lambda x: x IS NOT NULL), '; ') AS problems FROM e""")
def ingest_problems(spark, sf_dir):
    e = tables.log(spark, sf_dir)
    odd = e.select("seq", "id", "session", F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("family")).alias("family"), F.when(F.col("seq") % 13 != 0, F.col("actor")).alias("actor"), F.when(F.col("seq") % 17 == 0, F.concat(F.lit("lost:"), F.col("seq").cast("string"))).when(F.col("seq") % 2 == 0, F.col("id")).alias("parent"))
    return log.ingest_problems(odd)


@query("""WITH {log}, e AS (SELECT id AS node_id, seq AS ts, CASE WHEN seq % 2 = 0 THEN 0.25 END AS weight FROM log), a AS (SELECT node_id, count(*) FILTER (weight IS NULL) AS u, max(ts) FILTER (weight IS NULL) AS l, coalesce(sum(weight), 0) AS w FROM e GROUP BY node_id),
o AS (SELECT DISTINCT id AS node_id, 1 AS usage, 5 AS last_seen, 0.5 AS upholds FROM log WHERE seq < 1000)
SELECT coalesce(a.node_id, o.node_id) AS node_id, coalesce(usage, 0) + coalesce(u, 0) AS usage, greatest(last_seen, l) AS last_seen, CAST(round(coalesce(upholds, 0) + coalesce(w, 0), 4) AS DOUBLE) AS upholds FROM a FULL JOIN o ON a.node_id = o.node_id""")
def telemetry_merge(spark, sf_dir):
    e = tables.log(spark, sf_dir)
    now = e.filter("seq < 1000").select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("usage"), F.lit(5).cast("long").alias("last_seen"), F.lit(0.5).alias("upholds")).distinct()
    return log.merge_telemetry(now, e.select(F.col("id").alias("node_id"), F.col("seq").alias("ts"), F.when(F.col("seq") % 2 == 0, 0.25).alias("weight")))


@query(r"""SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host, CASE WHEN regexp_matches('file:' || url, '^(mem|int|task|plan|sym|file|module):') AND NOT regexp_matches(url, '\s') THEN true ELSE false END AS is_locator FROM pages""")
def locator_parse(spark, sf_dir):
    pages = tables.read(spark, sf_dir, "pages")
    return pages.select("page_id", F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")).alias("host"), F.coalesce(text.is_locator(F.concat(F.lit("file:"), F.col("url"))), F.lit(False)).alias("is_locator"))


@query(r"""WITH s AS (SELECT doc_id, trim(substr(array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')[1:6], '-'), 1, 48), '-') AS slug FROM documents) SELECT doc_id, CASE WHEN slug = '' THEN 'memory' ELSE slug END AS slug FROM s""")
def slugify(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT c_custkey, 'memo' AS head, CAST(c_custkey % 9 + 1 AS INTEGER) AS num, c_custkey % 2 = 0 AS done, c_name AS text FROM customer""")
def task_lines(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    body = F.concat(F.lit("---\nmemo\n---\n# plan\n- ["), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(" "), F.lit("] {#"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("} "), F.col("c_name"), F.lit("\n"))
    parsed = c.select("c_custkey", text.frontmatter(body).alias("f"))
    return parsed.select("c_custkey", F.col("f.head").alias("head"), F.explode(text.task_lines(F.col("f.body"))).alias("t")).select("c_custkey", "head", "t.num", "t.done", "t.text")


@query("""WITH m AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, sum(length(text) // 3) AS tokens FROM conversations GROUP BY conv_id)
SELECT median(turns) AS turns, median(replies) AS replies, median(tokens) AS tokens FROM m""")
def transcript_metrics(spark, sf_dir):
    per = tables.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))
    return per.agg(F.median("turns").alias("turns"), F.median("replies").alias("replies"), F.median("tokens").alias("tokens"))


@query("""WITH {log}, n AS (SELECT family AS node_id, max(seq) AS last_rank, arg_max(id, seq) AS label FROM log GROUP BY family) SELECT node_id, last_rank, label FROM n""")
def fold_nodes(spark, sf_dir):
    e = tables.log(spark, sf_dir)
    edge = F.struct(F.lit("tracks").alias("relation"), F.lit("click").alias("target"), F.lit(False).alias("pending"))
    nodes, _, _ = log.fold(e.select(F.col("seq").alias("rank"), "id", F.col("family").alias("locator"), "family", F.lit("task").alias("kind"), F.col("id").alias("label"), F.array(edge).alias("edges")))
    return nodes.select("node_id", "last_rank", "label")


_FOLD = """, a AS (SELECT seq, id, CASE seq % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'ghost' ELSE 'purchase' END || ':' || project AS target, seq % 5 = 0 AS pending FROM log),
born AS (SELECT id, min(seq) AS born FROM log GROUP BY id), e AS (SELECT a.*, born FROM a LEFT JOIN born ON born.id = target)"""


def _folded(spark, sf_dir):
    e = tables.log(spark, sf_dir)
    kind = F.when(F.col("seq") % 3 == 0, "click").when(F.col("seq") % 3 == 1, "ghost").otherwise("purchase")
    edge = F.struct(F.lit("tracks").alias("relation"), F.concat_ws(":", kind, F.col("project").cast("string")).alias("target"), (F.col("seq") % 5 == 0).alias("pending"))
    return log.fold(e.select(F.col("seq").alias("rank"), "id", F.lit(None).cast("string").alias("locator"), "family", F.lit("task").alias("kind"), F.col("id").alias("label"), F.array(edge).alias("edges")))


@query("WITH {log}" + _FOLD + " SELECT id AS src, target AS dst, 'tracks' AS relation, pending, count(*) AS c, min(seq) AS first_rank FROM e WHERE born <= seq GROUP BY ALL")
def fold_edges(spark, sf_dir):
    return _folded(spark, sf_dir)[1].groupBy("src", "dst", "relation", "pending").agg(F.count("*").alias("c"), F.min("rank").alias("first_rank"))


@query("WITH {log}" + _FOLD + " SELECT id AS src, target, 'tracks' AS relation, count(*) AS c, max(seq) AS last_rank FROM e WHERE born IS NULL OR born > seq GROUP BY ALL")
def fold_dangling(spark, sf_dir):
    return _folded(spark, sf_dir)[2].groupBy("src", "target", "relation").agg(F.count("*").alias("c"), F.max("rank").alias("last_rank"))


#: The documents as assertions, as tables.assertions has them.
_ASSERTED = """asr AS (SELECT doc_id, substr(sha256('a' || doc_id), 1, 12) AS id, CASE WHEN doc_id % 3 = 0 THEN 'int:l' || (doc_id % 40) END AS locator,
  CASE doc_id % 3 WHEN 0 THEN 'intent' WHEN 1 THEN 'memory' ELSE 'resolution' END AS family, source AS label, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang,
  CASE WHEN doc_id > 0 THEN CASE WHEN doc_id // 2 % 3 = 0 THEN 'int:l' || (doc_id // 2 % 40) ELSE substr(sha256('a' || (doc_id // 2)), 1, 12) END END AS target, doc_id % 5 = 0 AS pending,
  CASE WHEN doc_id % 97 = 50 THEN doc_id + 1 WHEN doc_id % 97 = 51 THEN doc_id - 1 WHEN doc_id > 0 AND doc_id % 4 <> 3 THEN doc_id // 2 END AS p1, CASE WHEN doc_id % 97 NOT IN (50, 51) AND doc_id > 0 AND doc_id % 4 <> 3 THEN doc_id // 3 END AS p2 FROM documents)"""


def _placed(name: str, where: str = "true") -> str:
    """SQL of (id, place, cyclic) for the assertions of a part: the least ready id is taken again and again, a bit for each that is."""
    return f"""{name}_n AS (SELECT *, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS i FROM asr WHERE {where}),
{name}_p AS (SELECT n.i, a.i AS p, b.i AS q FROM {name}_n n LEFT JOIN {name}_n a ON a.doc_id = n.p1 LEFT JOIN {name}_n b ON b.doc_id = n.p2),
{name}_s(k, done, i) AS (SELECT 0, bitstring('0', CAST((SELECT count(*) + 1 FROM {name}_n) AS INTEGER)), CAST(NULL AS INTEGER)
  UNION ALL (SELECT k + 1, set_bit(done, m, 1), m FROM (SELECT s.k, s.done, min(x.i) AS m FROM {name}_s s JOIN {name}_p x ON get_bit(s.done, x.i) = 0 AND (x.p IS NULL OR get_bit(s.done, x.p) = 1) AND (x.q IS NULL OR get_bit(s.done, x.q) = 1) GROUP BY s.k, s.done) t)),
{name}_o AS (SELECT n.*, s.k IS NULL AS cyclic, CAST(row_number() OVER (ORDER BY s.k IS NULL, s.k, n.id) - 1 AS BIGINT) AS place FROM {name}_n n LEFT JOIN {name}_s s ON s.i = n.i)"""


def _fold(name: str) -> str:
    """SQL of the nodes that a placed part folds to."""
    return f"""{name}_r AS (SELECT *, coalesce(locator, id) AS node FROM {name}_o),
{name}_b AS (SELECT node, min(place) AS born, max(place) AS last FROM {name}_r GROUP BY node),
{name}_e AS (SELECT r.node AS src, r.target AS dst, r.place, r.pending, t.born <= r.place AS found, NOT r.pending AND t.last <= r.place AS hits, s.last = r.place AS newest FROM {name}_r r JOIN {name}_b s ON s.node = r.node LEFT JOIN {name}_b t ON t.node = r.target WHERE r.target IS NOT NULL),
{name}_f AS (SELECT r.node AS node_id, arg_max(family, place) AS family, arg_max(label, place) AS label, arg_max(lang, place) FILTER (lang IS NOT NULL) AS lang,
  (SELECT count(*) FROM {name}_e e WHERE e.dst = r.node AND found AND hits) AS superseded_in, (SELECT count(*) FROM {name}_e e WHERE e.src = r.node AND found AND NOT pending AND newest) AS supersedes_out FROM {name}_r r GROUP BY r.node)"""


@query("WITH RECURSIVE " + _ASSERTED + ", " + _placed("l") + " SELECT id, place, cyclic FROM l_o")
def causal_order(spark, sf_dir):
    return A.causal_order(tables.assertions(spark, sf_dir))


@query("WITH RECURSIVE " + _ASSERTED + ", " + _placed("l") + ", " + _fold("l") + " SELECT *, superseded_in = 0 AS accepted FROM l_f")
def fold_revisions(spark, sf_dir):
    """Revisions of locators, folded in causal order."""
    return A.fold(tables.assertions(spark, sf_dir).drop("doc_id")).nodes.select("node_id", "family", F.col("attrs")["label"].alias("label"), F.col("attrs")["lang"].alias("lang"), "superseded_in", "supersedes_out", "accepted")


@query("WITH RECURSIVE " + _ASSERTED + ", " + _placed("l") + ", " + _fold("l") + " SELECT src, dst, arg_max(pending, place) AS pending FROM l_e WHERE found GROUP BY src, dst")
def fold_revision_edges(spark, sf_dir):
    return A.fold(tables.assertions(spark, sf_dir).drop("doc_id")).edges.select("src", "dst", "pending")


def _replicated(spark, sf_dir):
    """Documents of even numbers are the workspace's, those whose number leaves no 1 by 3 the replica's; some are both."""
    every = tables.assertions(spark, sf_dir)
    local = every.filter("doc_id % 2 = 0")
    events = every.filter("doc_id % 3 <> 1").select("id", "locator", (F.col("doc_id") % 4).cast("string").alias("actor"), F.col("doc_id").alias("seq"))
    return A.replica_fold(A.fold(local.drop("doc_id")), every.filter("doc_id % 3 <> 1").drop("doc_id"), events, local.select("id"))


# every family of these assertions gives way to the workspace, so of a node that only the replica has the first assertion is taken
_REPLICA = "WITH RECURSIVE " + _ASSERTED + ", " + _placed("l", "doc_id % 2 = 0") + ", " + _fold("l") + ", " + _placed("r", "doc_id % 3 <> 1") + """,
r_r AS (SELECT *, coalesce(locator, id) AS node, row_number() OVER (PARTITION BY coalesce(locator, id) ORDER BY place) AS nth FROM r_o),
kept AS (SELECT * FROM r_r WHERE nth = 1 AND node NOT IN (SELECT node_id FROM l_f)),
hit AS (SELECT k.target FROM kept k WHERE NOT k.pending AND (k.target IN (SELECT node_id FROM l_f) OR EXISTS (SELECT 1 FROM kept t WHERE t.node = k.target AND t.place <= k.place))),
fin AS (SELECT node_id, label, superseded_in FROM l_f UNION ALL SELECT node, label, 0 FROM kept),
live AS (SELECT locator, doc_id % 4 AS actor, max(doc_id) AS seq FROM asr WHERE doc_id % 6 = 0 GROUP BY ALL)"""


@query(_REPLICA + " SELECT node_id, label, superseded_in + (SELECT count(*) FROM hit WHERE target = node_id) AS superseded_in FROM fin")
def replica_fold(spark, sf_dir):
    return _replicated(spark, sf_dir)[0].nodes.select("node_id", F.col("attrs")["label"].alias("label"), "superseded_in")


@query(_REPLICA + " SELECT id FROM r_r EXCEPT SELECT id FROM kept")
def replica_declined(spark, sf_dir):
    return _replicated(spark, sf_dir)[0].declined.select("id")


@query(_REPLICA + """ SELECT DISTINCT r.locator FROM r_r r WHERE r.locator IS NOT NULL AND r.doc_id % 2 = 1 AND r.id NOT IN (SELECT id FROM kept)
AND NOT EXISTS (SELECT 1 FROM live v WHERE v.locator = r.locator AND v.actor = r.doc_id % 4 AND v.seq > r.doc_id)""")
def replica_diverged(spark, sf_dir):
    return _replicated(spark, sf_dir)[1]


@query("""WITH {log}, r AS (SELECT id, family, 'view:' || project AS p, actor || ':' || session % 3 AS v, 's' || seq % 4 AS s FROM log)
SELECT id, family, list(DISTINCT p ORDER BY p) AS parents, list(DISTINCT v ORDER BY v) AS provenance, list(DISTINCT s ORDER BY s) AS scope FROM r GROUP BY id, family""")
def merge_assertions(spark, sf_dir):
    """The events as records of assertions that several writers made."""
    e = tables.log(spark, sf_dir)
    said = e.select("id", "family", F.array(F.concat(F.lit("view:"), F.col("project").cast("string"))).alias("parents"), F.array(F.concat_ws(":", F.col("actor").cast("string"), (F.col("session") % 3).cast("string"))).alias("provenance"), F.array(F.concat(F.lit("s"), (F.col("seq") % 4).cast("string"))).alias("scope"))
    return A.merge(said)


@query("""WITH {graph}, o AS (SELECT src, dst, relation, 0 AS p, pending FROM edges WHERE relation = 'supersedes' UNION ALL SELECT src, dst, relation, 1, NOT pending FROM edges WHERE relation IN ('supersedes', 'serves'))
SELECT src, dst, relation, arg_min(pending, p) AS pending FROM o GROUP BY src, dst, relation""")
def union_merge_edges(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    side = lambda relations, flip: G.Graph(g.nodes.select("node_id", "label"), g.edges.filter(F.col("relation").isin(relations)).select("src", "dst", "relation", (~F.col("pending") if flip else F.col("pending")).alias("pending")), g.dangling)
    return G.union_merge(side(["supersedes"], False), side(["supersedes", "serves"], True))[1]


@query("WITH {graph}, " + _VEC + f""", live AS (SELECT node_id FROM nodes WHERE family = 'memory' AND status = 'active' AND node_id NOT IN (SELECT dst FROM edges WHERE relation = 'supersedes' AND NOT pending)),
s AS (SELECT a.id AS x, b.id AS y, a.anchor, round(list_dot_product(a.vec, b.vec), 6) AS cosine, 'similar' AS origin FROM v a JOIN v b ON a.anchor = b.anchor AND a.id < b.id WHERE round(list_dot_product(a.vec, b.vec), 6) >= {SIMILAR}),
p AS (SELECT 'mem:c' || x AS a, 'mem:c' || y AS b, anchor, cosine, origin FROM s WHERE (x + y) % 7 <> 0),
m AS (SELECT l AS a, r AS b, min(c.dst) AS anchor, NULL AS cosine, 'nominated' AS origin FROM (SELECT DISTINCT l, r FROM (""" + _NOMINATED + """)) JOIN edges c ON c.src = l AND c.relation = 'concerns' JOIN edges d ON d.src = r AND d.relation = 'concerns' AND d.dst = c.dst GROUP BY l, r),
u AS (SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, anchor, cosine, origin FROM (SELECT * FROM p UNION ALL SELECT * FROM m))
SELECT left_id, right_id, min(anchor) AS anchor, max(cosine) AS cosine, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origin FROM u WHERE left_id IN (SELECT node_id FROM live) AND right_id IN (SELECT node_id FROM live) GROUP BY left_id, right_id""")
def conflicts(spark, sf_dir):
    """Similar and nominated pairs of live memories that no verdict has closed; pairs whose numbers sum to a multiple of 7 have one."""
    g = tables.graph(spark, sf_dir)
    mem = lambda c: F.concat(F.lit("mem:c"), F.col(c).cast("string")).alias(c)
    live = apart(materialize(beliefs.live_memories(g).select("node_id")))
    vectors = tables.vectors(spark, sf_dir).join(live, F.concat(F.lit("mem:c"), F.col("id").cast("string")) == F.col("node_id"), "left_semi")
    raw = retrieval.near_pairs(vectors, SIMILAR)
    verdicts = raw.filter("(left_id + right_id) % 7 = 0").select(mem("left_id").alias("left"), mem("right_id").alias("right"), F.lit("reconcile").alias("kind"))
    return beliefs.conflicts(g, raw.select(mem("left_id"), mem("right_id"), "anchor", "cosine"), _nominated_pairs(spark, sf_dir), verdicts, live)


@query("""WITH {drift} SELECT dst, count(*) AS c, string_agg(src, ',' ORDER BY src) AS sources FROM soft WHERE relation = 'concerns' GROUP BY dst HAVING count(*) > 1""")
def drift_by_locus(spark, sf_dir):
    return drift.by_locus(tables.graph(spark, sf_dir))


@query("""WITH {drift} SELECT e.src AS node_id FROM edges e WHERE e.relation = 'concerns' AND e.dst LIKE 'sym:part.py#p1%' GROUP BY e.src HAVING NOT bool_or(EXISTS (SELECT 1 FROM items i WHERE i.kind <> 'renamed' AND i.src = e.src AND i.dst = e.dst))""")
def upheld_memories(spark, sf_dir):
    g = tables.graph(spark, sf_dir)
    return drift.upheld(g, g.nodes.filter("node_id like 'sym:part.py#p1%'").select("node_id"))


@query("""WITH {drift} SELECT 'conflict' AS kind, (SELECT count(*) FROM edges WHERE relation = 'supersedes' AND pending) AS c
UNION ALL SELECT 'stale', (SELECT count(*) FROM items WHERE kind <> 'renamed' AND relation = 'implements' AND src IN (SELECT src FROM done)) UNION ALL SELECT 'drift', (SELECT count(*) FROM surf)""")
def obligation_counts(spark, sf_dir):
    return drift.counts(drift.obligations(tables.graph(spark, sf_dir)))


@query("""WITH {drift}, k AS (SELECT 0 AS r, 'conflict' AS kind, src || '|' || dst AS key FROM edges WHERE relation = 'supersedes' AND pending
UNION ALL SELECT 1, 'stale', src || '|' || dst FROM items WHERE kind <> 'renamed' AND relation = 'implements' AND src IN (SELECT src FROM done)
UNION ALL SELECT 2, 'drift', kind || '|' || src || '|' || dst || '|' || relation FROM surf), o AS (SELECT *, row_number() OVER (ORDER BY r, key) AS place, count(*) OVER () AS n FROM k)
SELECT CAST(place AS INTEGER) AS place, kind, key, n - 10 AS more FROM o WHERE place <= 10""")
def obligation_notice(spark, sf_dir):
    return drift.notice(drift.obligations(tables.graph(spark, sf_dir)), 10)


@query("""WITH {drift}, a AS (SELECT src, dst, relation, 'hard' AS state FROM hard0 UNION ALL SELECT e.src, e.dst, e.relation, CASE WHEN e.anchor <> n.content_hash THEN 'soft' ELSE '' END FROM edges e LEFT JOIN nodes n ON n.node_id = e.dst WHERE e.relation IN ('implements', 'concerns', 'grounded_by'))
SELECT src, dst, relation, coalesce(state, '') AS state FROM a""".replace("WITH {drift}", "WITH {drift}, hard0 AS (SELECT src, target AS dst, relation FROM dangling)"))
def anchor_state(spark, sf_dir):
    return context.anchor_state(tables.graph(spark, sf_dir))


@query("""WITH {graph}, sup AS (SELECT DISTINCT dst FROM edges WHERE relation = 'supersedes' AND NOT pending)
SELECT node_id, CASE family WHEN 'plan' THEN coalesce(state, '') <> 'done' WHEN 'memory' THEN status = 'active' AND node_id NOT IN (SELECT dst FROM sup) WHEN 'intent' THEN status <> 'archived' ELSE true END AS reverifiable FROM nodes""")
def reverifiable(spark, sf_dir):
    return context.reverifiable(tables.graph(spark, sf_dir))


@query("""WITH {graph}, hit AS (SELECT node_id FROM nodes WHERE starts_with(lower(node_id), 'mem:c1') OR starts_with(lower(node_id), 'mem:mem:c1')) SELECT node_id FROM hit WHERE node_id = 'mem:C1' OR NOT EXISTS (SELECT 1 FROM hit WHERE node_id = 'mem:C1')""")
def resolve_prefix(spark, sf_dir):
    return context.resolve(tables.graph(spark, sf_dir), "mem:C1")


@query("""WITH {graph}, s AS (SELECT * FROM (VALUES ('int:n3'), ('sym:part.py#p100'), ('task:o/7')) t(node_id))
SELECT e.src AS node_id, 'out' AS way, relation, e.dst AS other FROM edges e JOIN s ON s.node_id = e.src UNION ALL SELECT e.dst, 'in', relation, e.src FROM edges e JOIN s ON s.node_id = e.dst
UNION ALL SELECT d.src, 'lost', relation, target FROM dangling d JOIN s ON s.node_id = d.src""")
def neighbourhood(spark, sf_dir):
    return context.neighbourhood(tables.graph(spark, sf_dir), spark.createDataFrame([("int:n3",), ("sym:part.py#p100",), ("task:o/7",)], "node_id string"))


@query()
def context_packet(spark, sf_dir):
    """place, section, node_id, line of a topic's packet; tested on a small graph."""
    found = context.context(tables.graph(spark, sf_dir), "customer part germany", now=NOW)
    return spark.createDataFrame(found.rows, "place int, section string, node_id string, line string")


@query()
def locus_packet(spark, sf_dir):
    found = context.context_for_locus(tables.graph(spark, sf_dir), "part.py", now=NOW)
    return spark.createDataFrame(found.rows if found else [], "place int, section string, node_id string, line string")


@query()
def session_packet(spark, sf_dir):
    found = context.session_context(tables.graph(spark, sf_dir), now=NOW)
    return spark.createDataFrame(found.rows if found else [], "place int, section string, node_id string, line string")


@query("""WITH {log}, l AS (SELECT id, min(seq) AS seq, CAST(arg_min(actor, seq) AS VARCHAR) AS actor FROM log GROUP BY id),
c AS (SELECT DISTINCT 'click:' || user_id AS left_id, 'purchase:' || user_id AS right_id FROM events),
o AS (SELECT coalesce(CASE WHEN coalesce(r.seq, -1) > coalesce(a.seq, -1) THEN r.actor ELSE a.actor END, 'unattributed') AS owner FROM c LEFT JOIN l a ON a.id = left_id LEFT JOIN l r ON r.id = right_id)
SELECT owner, count(*) AS c FROM o GROUP BY owner""")
def owner_tally(spark, sf_dir):
    return log.owner_tally(assign_responsibility(spark, sf_dir))


@query("""WITH {log}, c AS (SELECT id AS path, seq, max(seq) OVER () - seq AS pos FROM log), b AS (SELECT path, max(pos) AS pos FROM c WHERE path NOT LIKE 'click:%' GROUP BY path)
SELECT l.id AS node_id, coalesce(max(pos), 0) AS survival FROM (SELECT DISTINCT id FROM log) l LEFT JOIN b ON path = l.id GROUP BY l.id""")
def head_distance(spark, sf_dir):
    e = tables.log(spark, sf_dir)
    last = e.agg(F.max("seq").alias("last"))
    commits = e.filter("id not like 'click:%'").crossJoin(F.broadcast(last)).select(F.col("id").alias("path"), (F.col("last") - F.col("seq")).alias("pos"))  # one row
    return log.head_distance(e.select(F.col("id").alias("node_id"), F.col("id").alias("path")).distinct(), commits)


@query("""WITH {log}, m AS (SELECT project, max(seq) FILTER (seq <= 5000) AS seen, max(seq) AS head, bool_or(seq > 5000 AND seq % 499 = 0) AS bad FROM log GROUP BY project)
SELECT project, NOT bad AS ok, head AS head_seq FROM m WHERE head > 5000""")
def sync_verify(spark, sf_dir):
    """What came after seq 5000, against the chain's ends there; in some deltas a body was changed on the way."""
    chain = log.build_chain(tables.log(spark, sf_dir))
    tails = chain.filter("seq <= 5000").groupBy("project").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
    delta = chain.filter("seq > 5000").withColumn("event_key", F.when(F.col("seq") % 499 == 0, "changed").otherwise(F.col("event_key")))
    return log.verify_delta(delta, tails).select("project", "ok", "head_seq")


@query(r"""SELECT page_id, list_transform(list_filter(string_split(regexp_extract(url, '([0-9]+(?:\.[0-9]+)*)', 1), '.'), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS version FROM pages""".replace(r"\\.", r"\."))
def version_keys(spark, sf_dir):
    found = F.regexp_extract("url", r"([0-9]+(?:\.[0-9]+)*)", 1)
    return tables.read(spark, sf_dir, "pages").select("page_id", text.version_key(found).alias("version"))


@query("""WITH RECURSIVE {log}, f AS (SELECT *, row_number() OVER (PARTITION BY project, id, body ORDER BY seq) AS nth FROM log),
k AS (SELECT *, sha256(project || chr(0) || id || chr(0) || body) AS event_key, row_number() OVER (PARTITION BY project ORDER BY seq) AS i FROM f WHERE nth = 1),
c AS (SELECT DISTINCT project, 0 AS i, CAST(NULL AS VARCHAR) AS id, repeat('0', 64) AS entry_hash FROM log UNION ALL (SELECT k.project, k.i, k.id, sha256(c.entry_hash || chr(0) || k.event_key) FROM c JOIN k ON k.project = c.project AND k.i = c.i + 1))
SELECT project, CAST(i AS BIGINT) AS seq, id, entry_hash FROM c WHERE i > 0""")
def chain_stream(spark, sf_dir):
    """The chain of each project as a stream makes it, with its own numbers; repeated events are passed over."""
    where = f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    # a stream reads folders
    events = spark.readStream.schema(tables.read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    state.run(state.chained(tables.as_log(events)), f"{where}/log", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/log").select("project", "seq", "id", "entry_hash")


@query("""WITH r AS (SELECT user_id % 7 AS project, 's' || (user_id % 20) AS session, event_id AS t, list_distinct([event_type, 'k' || (event_id % 4), 'u' || (user_id % 3)]) AS keys FROM events),
b AS (SELECT *, lag(keys) OVER (PARTITION BY project, session ORDER BY t) AS was FROM r), x AS (SELECT project, session, t, unnest(keys) AS key, was FROM b)
SELECT project, session, t AS "at", key FROM x WHERE NOT coalesce(list_contains(was, key), false)""")
def session_announcements(spark, sf_dir):
    """Each event reports three open keys; a session is told of those that its report before did not have."""
    user = F.col("user_id").cast("string")
    reports = tables.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("project"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("session"), F.col("event_id").alias("at"), F.array_distinct(F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))).alias("keys"))
    return state.announcements(reports)


@query("""WITH e AS (SELECT user_id % 5 AS project, event_id, substr(sha256(event_type || ':' || user_id || ':' || props), 1, 16) AS id, user_id % 3 AS actor FROM events)
SELECT project, count(DISTINCT id || '/' || actor) AS events, count(DISTINCT id || '/' || actor) AS highest, true AS alike FROM e WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY project""")
def sync_converge(spark, sf_dir):
    """Two workspaces, with the events of even numbers and of multiples of 3, exchange over a shared log; each project's events, its last number, and whether both replicas are like the log."""
    e = tables.read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    said = e.select("event_id", (F.col("user_id") % 5).alias("project"), F.substring(F.sha2(F.concat_ws(":", "event_type", user, "props"), 256), 1, 16).alias("id"), F.array().cast("array<string>").alias("parents"), F.to_json(F.struct(F.col("event_type").alias("family"))).alias("body"), (F.col("user_id") % 3).cast("string").alias("actor"), F.lit("s").alias("session"))
    where = f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    remote = exchange.Log(spark, f"{where}/log")
    replicas = [exchange.Replica(spark, f"{where}/{n}") for n in "ab"]
    for n, replica in ((2, replicas[0]), (3, replicas[1])):
        exchange.exchange(said.filter(F.col("event_id") % n == 0).drop("event_id"), replica, remote)
    replicas[0].sync(remote)
    print_ = lambda df, name: df.groupBy("project").agg(F.count("*").alias("n" + name), F.bit_xor(F.xxhash64("seq", "id", "event_key", "entry_hash")).alias("x" + name))
    both = print_(replicas[0].events(), "a").join(print_(replicas[1].events(), "b"), "project")
    held = remote.events().groupBy("project").agg(F.count("*").alias("events"), F.max("seq").alias("highest"), F.bit_xor(F.xxhash64("seq", "id", "event_key", "entry_hash")).alias("x"))
    return held.join(both, "project").select("project", "events", "highest", ((F.col("xa") == F.col("x")) & (F.col("xb") == F.col("x")) & (F.col("na") == F.col("events")) & (F.col("nb") == F.col("events"))).alias("alike"))


def _index(spark, sf_dir):
    """An index of the embeddings that took two refreshes: two thirds of the vectors first, and then all, of which those divisible by 7 were others at first."""
    v = tables.vectors(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), F.col("anchor").alias("text"), F.col("vec").cast("array<double>").alias("vec"), F.col("id").alias("n"))
    index = vector_index.Index(spark, f"{checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}", size=256)
    before = v.filter("n % 3 <> 0").select("id", F.when(F.col("n") % 7 == 0, "old").otherwise(F.col("text")).alias("text"), F.when(F.col("n") % 7 == 0, F.reverse("vec")).otherwise(F.col("vec")).alias("vec"))
    index.refresh(before)
    index.refresh(v.drop("n"))
    return index, v


_UNIT = "u AS (SELECT 'v' || vec_id AS id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), w AS (SELECT *, sqrt(list_dot_product(vec, vec)) AS len FROM u)"


@query("WITH " + _UNIT + """, c AS (SELECT q.id AS query, w.id, round(list_dot_product(w.vec, q.vec) / (w.len * q.len), 6) AS cosine FROM w, w q WHERE q.n % 50 = 0 AND w.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 10""")
def index_topk(spark, sf_dir):
    index, v = _index(spark, sf_dir)
    return index.topk(v.filter("n % 50 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec")), 10)


@query("WITH " + _UNIT + " SELECT w.id, round(list_dot_product(w.vec, q.vec) / (w.len * q.len), 6) AS cosine FROM w, w q WHERE q.id = (SELECT min(id) FROM w)")
def semantic_scores(spark, sf_dir):
    index, v = _index(spark, sf_dir)
    return index.scores(v.orderBy("id").select("vec").first().vec)


_COUNTED = """e AS (SELECT 'mem:c' || (user_id % 150) AS node_id, event_id AS ts, event_id % 2 = 0 AS even FROM events),
k AS (SELECT node_id, ts, count(*) OVER w AS usage, sum(CASE WHEN even THEN 0.25 ELSE 0 END) OVER w AS upholds FROM e WINDOW w AS (PARTITION BY node_id ORDER BY ts))"""


@query("WITH {graph}, " + _COUNTED + """, s AS (SELECT n.node_id, maturity AS was, (SELECT count(*) FROM edges x WHERE x.dst = n.node_id AND x.relation = 'supersedes' AND NOT x.pending) AS superseded_in FROM nodes n WHERE family = 'memory'),
l AS (SELECT node_id, max(ts) AS ts FROM k WHERE ts <= 6000 GROUP BY node_id),
o AS (SELECT s.*, coalesce(k.usage, 0) AS usage, k.ts AS last_seen, CAST(coalesce(k.upholds, 0) AS DOUBLE) AS upholds, greatest(length(s.node_id) % 4, coalesce(6000 - (SELECT min(ts) FROM k x WHERE x.node_id = s.node_id), 0)) AS survival FROM s LEFT JOIN l ON l.node_id = s.node_id LEFT JOIN k ON k.node_id = l.node_id AND k.ts = l.ts)
SELECT node_id, usage, last_seen, upholds, survival, was, CASE WHEN was = 'proposed' AND upholds < 1 THEN 'proposed' WHEN upholds >= 3 AND superseded_in = 0 THEN 'settled' ELSE 'working' END AS maturity FROM o""")
def telemetry_overlay(spark, sf_dir):
    """Memories as read at 6000: counters that events moved on until then, the greater of two clocks, and the maturity."""
    g = tables.graph(spark, sf_dir)
    e = tables.read(spark, sf_dir, "events").select(F.concat(F.lit("mem:c"), (F.col("user_id") % 150).cast("string")).alias("node_id"), F.col("event_id").alias("ts"))
    so_far = Window.partitionBy("node_id").orderBy("ts")
    counters = e.select("node_id", "ts", F.count("*").over(so_far).alias("usage"), F.col("ts").alias("last_seen"), F.sum(F.when(F.col("ts") % 2 == 0, 0.25).otherwise(0.0)).over(so_far).alias("upholds"))
    memories = g.nodes.filter("family = 'memory'").select("node_id", "maturity").join(G.supersession(g).select("node_id", "superseded_in"), "node_id")
    commits = memories.select("node_id", (F.length("node_id") % 4).alias("survival"))
    clocks = overlay.survival(memories, commits, e.groupBy("node_id").agg((6000 - F.min("ts")).alias("survival")))
    return overlay.overlay(memories, counters, clocks, 6000)


@query()
def suggestions(spark, sf_dir):
    """Parts' names without their third character, against all names; tested against all pairs."""
    names = tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("id"))
    wrong = tables.read(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 200)).alias("asked"))
    return suggest.suggest(wrong, names)


@query("""WITH RECURSIVE s AS (SELECT 'f' || (o_custkey % 40) AS file, o_orderkey % 97 AS first, o_orderkey % 97 + o_orderkey % 31 AS last, min('n' || (o_orderkey % 5)) AS name FROM orders GROUP BY 1, 2, 3),
h AS (SELECT a.file, a.first, a.last, arg_min(CAST([b.first, b.last] AS BIGINT[]), [-b.first, b.last]) AS up FROM s a JOIN s b ON b.file = a.file AND b.first <= a.first AND b.last >= a.last AND (b.first <> a.first OR b.last <> a.last) GROUP BY a.file, a.first, a.last),
t AS (SELECT s.*, up FROM s LEFT JOIN h ON h.file = s.file AND h.first = s.first AND h.last = s.last),
q AS (SELECT file, first, last, name, CAST(NULL AS VARCHAR) AS container, name AS qualname FROM t WHERE up IS NULL
  UNION ALL SELECT t.file, t.first, t.last, t.name, q.qualname, q.qualname || '.' || t.name FROM t JOIN q ON q.file = t.file AND q.first = t.up[1] AND q.last = t.up[2]),
r AS (SELECT *, row_number() OVER (PARTITION BY file, qualname ORDER BY first, last DESC) AS i FROM q)
SELECT file, first, last, name, container, qualname FROM r WHERE i = 1""")
def containment(spark, sf_dir):
    """Orders as definitions on spans of lines."""
    o, key = tables.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    spans = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("file"), (key % 97).alias("first"), (key % 97 + key % 31).alias("last"), F.concat(F.lit("n"), (key % 5).cast("string")).alias("name"), F.lit("function").alias("kind"))
    return nesting.nest(spans).drop("kind")

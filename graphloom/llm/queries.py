"""One thin query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, conversation_trie, decontamination, jaccard, license_scan, line_dedup, quality_classifier, quality_rules, secret_scan, sharding, source_divergence, substring_dedup, token_counts
from graphloom.llm.shared import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARDS = 40


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard(narrow, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, carry=["doc_id"])


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id"])
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
st AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN rep ON rep.rid = w.rid),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM v GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, count(*) AS hosts FROM h),
s AS (SELECT sum(h.n * (h.f / h.n - t.mean) * (h.f / h.n - t.mean)) AS ss FROM h, t),
p AS (SELECT mean, CASE WHEN (ss - mean * (1 - mean) * (hosts - 1)) / n * 1001 <= mean * (1 - mean) THEN 1000.0
    ELSE greatest(1.0, mean * (1 - mean) / ((ss - mean * (1 - mean) * (hosts - 1)) / n) - 1) END AS strength FROM t, s),
bad AS (SELECT source FROM h, p WHERE (f + strength * mean) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM v.source) AS kept
FROM v
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
j AS (SELECT k.*, hot.key IS NOT NULL AS drop_it FROM k LEFT JOIN hot ON hot.key = k.key)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN drop_it THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '')) AS kept_sha256
FROM j JOIN d ON d.rid = j.rid GROUP BY j.rid
"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (SELECT rid, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
s AS (SELECT DISTINCT rid, s FROM g),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT r.x, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.y GROUP BY r.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w JOIN c ON c.x = w.rid LEFT JOIN n ON n.rid = w.rid
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


SQL["op4_license_scan"] = r"""
WITH tpl(t, label, base, pairs, q, pair) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, w, unnest(range(1, len(w))) AS p FROM d),
hit AS (SELECT rid, t, label, base, pairs, q, p - 1 - q AS dg FROM g JOIN tpl ON tpl.pair = w[p] || ' ' || w[p + 1]),
votes AS (SELECT rid, t, label, base, pairs, dg, list(DISTINCT q) AS qs FROM hit GROUP BY ALL),
steps AS (SELECT *, CASE WHEN base OR lag(dg) OVER (PARTITION BY rid, t ORDER BY dg) IS NULL OR dg - lag(dg) OVER (PARTITION BY rid, t ORDER BY dg) > 3 THEN 1 ELSE 0 END AS n FROM votes),
merged AS (SELECT *, sum(n) OVER (PARTITION BY rid, t ORDER BY dg ROWS UNBOUNDED PRECEDING) AS passage FROM steps),
pas AS (SELECT rid, t, label, base, pairs, passage, min(dg) AS start, len(list_distinct(flatten(list(qs)))) AS covered FROM merged GROUP BY ALL),
ok AS (SELECT *, base AND covered = pairs AS place, CASE WHEN base THEN covered = pairs ELSE covered / CAST(pairs AS DOUBLE) >= 0.8 END AS found FROM pas),
r AS (SELECT rid, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
  max(covered / CAST(pairs AS DOUBLE)) FILTER (found) AS score FROM ok GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r ON r.rid = d.rid
""".replace("{templates}", ", ".join(f"({t}, '{label}', {base}, {pairs}, {q}, '{pair}')" for t, label, base, pairs, q, pair in license_scan.template_rows(license_scan.PHRASES, license_scan.NOTICES)))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return token_counts.count(table(spark, sf_dir, "documents"), path, pattern)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"), min_words=30)


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), min_documents=3, most_terms=200)


SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (CAST(g.total AS HUGEINT) + v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS total FROM g GROUP BY lang),
q AS (SELECT x.lang, x.term, 1 + CAST(1000000000 AS HUGEINT) * (x.n + 1) // (l.total + v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) x JOIN l ON l.lang = x.lang JOIN v ON v.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = conversation_trie.rebuild(conversation_trie.turns(table(spark, sf_dir, "conversations")), span=100, most=6)
    return conversation_trie.trie(rebuilt)


#: crc32 of the digits of conv_id, a bit at a time.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))), lambda r, d: list_reduce(list_prepend(xor(r, d), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
SQL["op13_conversation_trie"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above FROM s UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(above) AS above FROM p GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, above),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
u AS (SELECT p.depth, p.node, sum((m.n_convs - 1) * m.size) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.node),
z AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.depth, p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN z ON z.conv_id = p.conv_id AND z.depth = p.depth GROUP BY p.depth, p.node)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN u ON u.depth = m.depth AND u.node = m.node LEFT JOIN e ON e.depth = m.depth AND e.node = m.node LEFT JOIN m up ON up.depth = m.depth - 1 AND up.node = m.above
""".replace("{crc}", _CRC)


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != secret_scan.KIND)
    return found.select("doc_id", *(count(kind) for kind in secret_scan.RULES), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


#: Matches of a pattern in the texts of d, as (rid, start, end, value).
_HITS = """SELECT rid, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS e, vals[i] AS value
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', {g}) AS vals FROM d))"""
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL["op12_secret_scan"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT 0 AS k, 'assign' AS kind, * FROM ({assign}) WHERE length(value) >= 6
  UNION ALL SELECT 1, 'access', * FROM ({access}) WHERE length(value) >= 20
  UNION ALL SELECT 2, 'hex', * FROM ({hex}) WHERE length(value) >= 24),
c AS ({candidate}),
smp AS (SELECT DISTINCT rid, value, true AS random FROM m UNION ALL SELECT DISTINCT rid, value, false FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rid = c.rid AND m.value = c.value)),
ch AS (SELECT random, value, unnest(range(1, length(value))) AS i FROM smp),
pr AS (SELECT value[i] AS a, value[i + 1] AS b, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM ch GROUP BY 1, 2),
fi AS (SELECT a, sum(r) AS fr, sum(o) AS fo FROM pr GROUP BY a),
llr AS (SELECT pr.a, pr.b, CAST(floor((ln((r + 1) / CAST(fr + 68 AS DOUBLE)) - ln((o + 1) / CAST(fo + 68 AS DOUBLE))) * 1000 + 0.5) AS BIGINT) AS score FROM pr JOIN fi ON fi.a = pr.a),
cc AS (SELECT rid, s, e, value, unnest(range(1, length(value))) AS i FROM c),
sc AS (SELECT rid, s, e FROM cc JOIN llr ON llr.a = value[i] AND llr.b = value[i + 1] GROUP BY rid, s, e HAVING sum(score) >= 10000),
al AS (SELECT k, kind, rid, s, e FROM m UNION ALL SELECT 3, 'markov', rid, s, e FROM sc),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM al GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.rid = d.rid
""".replace("{assign}", _HITS.format(p=_ASSIGN, g=2)).replace("{access}", _HITS.format(p="AKIA[A-Z0-9]+", g=0)).replace("{hex}", _HITS.format(p="[0-9a-f]+", g=0)).replace("{candidate}", _HITS.format(p=secret_scan.CANDIDATE, g=0))

from pyspark.sql import functions as F

from graphloom.functions import scores, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms_split_identifiers(spark):
    assert one(spark, text.terms(F.lit("auth/session.py#validateToken"))) == ["auth", "session", "py", "validate", "token"]
    assert one(spark, text.terms(F.lit("HTTPServer2"))) == ["http", "server", "2"]
    assert one(spark, text.terms(F.lit(None).cast("string"))) == []


def test_slugs_and_locators(spark):
    assert one(spark, text.slugify(F.lit("Hello, World! a b c d e"))) == "hello-world-a-b-c-d"
    assert one(spark, text.slugify(F.lit("!!"))) == "memory"
    assert one(spark, text.is_locator(F.lit("mem:0a"))) and not one(spark, text.is_locator(F.lit("mem:0 a")))
    assert one(spark, text.explanation_ids(F.lit("see sym:a.py#f, and (mem:12)."))) == ["sym:a.py#f", "mem:12"]
    assert one(spark, text.line_range(F.lit("a.py:L3-L9"))).asDict() == {"path": "a.py", "first": 3, "last": 9}
    assert one(spark, text.line_range(F.lit("a.py"))).first is None


def test_artifacts(spark):
    got = one(spark, text.frontmatter(F.lit("---\nid: 1\n---\n- [x] {#2} two\n- [ ] {#1} one\n- no")))
    assert got.head == "id: 1"
    assert [(t.num, t.done, t.text) for t in one(spark, text.task_lines(F.lit(got.body)))] == [(1, False, "one"), (2, True, "two")]
    assert one(spark, text.frontmatter(F.lit("plain"))).head is None
    assert one(spark, text.source_block(F.lit("a\nb\nc"), F.lit(0), F.lit(2), 2)) == "1  a\n2  b"


def test_compositions_fold_from_the_left(spark):
    chain = lambda *r: one(spark, scores.compose_chain(F.array(*map(F.lit, r)).cast("array<string>")))
    assert chain("implements", "contains", "calls") == "depends_on"
    assert chain("contains", "calls") is None
    assert chain("serves") == "serves"
    assert chain() is None


def test_confidence_of_a_path(spark):
    rank = lambda *r: one(spark, scores.path_rank(F.array(*map(F.lit, r)).cast("array<int>")))
    assert (rank(2), rank(2, 2), rank(2, 0), rank()) == (2, 1, 0, 2)
    assert one(spark, scores.rank_of(F.lit("what"))) == 0


def test_grammar(spark):
    ok = lambda rel, a, b: one(spark, scores.well_typed(F.lit(rel), scores.id_tags(F.lit(a)), scores.id_tags(F.lit(b))))
    assert ok("implements", "task:m/1", "sym:a.py#f")
    assert not ok("implements", "mem:1", "sym:a.py#f")
    assert ok("unknown", "mem:1", "x")
    assert not ok("serves", "mem:1", "task:m/1") and ok("serves", "mem:1", "plan:m")


def test_greedy_fill_skips(spark):
    fill = lambda costs: one(spark, scores.greedy_fill(F.array(*map(F.lit, costs)).cast("array<long>"), 10))
    assert fill([5, 8, 4]) == [0, 2]
    assert fill([11]) == []


def test_tiers_are_a_strict_order(spark):
    rank = lambda *a: one(spark, scores.tier_rank(scores.tier(*(F.lit(x).cast("string") for x in a))))
    human = rank("memory", "decision", "docs", "human")
    must = rank("intent", "goal", None, None)
    tested = rank("memory", "rationale", "empirical", "agent")
    design = rank("memory", "decision", "docs", "agent")
    guess = rank("memory", "rationale", "docs", "agent")
    assert human < must < tested < design < rank("plan", "task", None, None) < rank("structure", "function", None, None) < guess


def test_maturity(spark):
    say = lambda m, up, sup, age, ok=True: one(spark, scores.maturity_verdict(F.lit(m), F.lit(up), F.lit(sup), F.lit(age), F.lit(ok)))
    assert say("proposed", 0.5, 0, 9) == "proposed"
    assert say("working", 3.0, 0, 9) == "settled"
    assert say("working", 3.0, 1, 9) == "working"


def test_ids_and_signatures(spark):
    import hashlib
    import hmac
    import json

    from graphloom.functions import ids

    rows = [("node", '{"b": [3, 1, 2], "a": {"y": 1, "x": ["q", "p"]}}'), ("node", '{"a": {"x": ["p", "q"], "y": 1}, "b": [1, 2, 3]}'), ("edge", '{"b": [1]}'), ("node", None)]
    frame = spark.createDataFrame(rows, "kind string, body string")
    got = [r.i for r in frame.select(ids.assertion_id(F.col("kind"), F.col("body")).alias("i")).collect()]
    payload = {"algo": "assertid-v1", "kind": "node", "body": {"a": {"x": ["p", "q"], "y": 1}, "b": [1, 2, 3]}}
    assert got[0] == got[1] == hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    assert got[2] != got[0] and got[3] is None
    record = {"actor": "a", "source": "review", "sig": "old"}
    signed = spark.createDataFrame([(json.dumps(record),), (None,)], "r string").select(ids.signature(F.col("r"), "key").alias("s"), ids.landing_maturity(F.col("r"), ["review"]).alias("m")).collect()
    assert signed[0].s == hmac.new(b"key", json.dumps({"actor": "a", "source": "review"}, sort_keys=True).encode(), hashlib.sha256).hexdigest()
    assert [r.m for r in signed] == ["proposed", "working"] and signed[1].s is None


def test_paths_and_versions(spark):
    frame = spark.createDataFrame([("A\\b/./C.py", "v1.10.2-rc"), ("x/../../y", "none"), ("a/b/../c", "2")], "p string, v string")
    got = frame.select(text.normal_path(F.col("p")).alias("p"), text.version_key(F.col("v")).alias("v")).collect()
    assert [(r.p, r.v) for r in got] == [("a/b/c.py", [1, 10, 2]), ("../y", []), ("a/c", [2])]
    one = frame.limit(1).select(text.enforced(F.lit("uses salt, no md5"), ["salt"], ["md5"]).alias("e"), text.enforced(F.lit("uses salt"), ["salt"], ["md5"]).alias("f")).first()
    assert (one.e.hits, one.e.breaks, one.e.enforced) == (1, 1, False) and one.f.enforced


def test_functions_in_sql(spark):
    from graphloom.functions import register
    from graphloom.operators import log

    assert len(register.register(spark)) == 6
    frame = spark.createDataFrame([("validateToken HTTPServer2", 86400 * 14, "a"), (None, 0, "b"), ("sym:a b", None, None), ("mem:x", 5, "")], "t string, seen bigint, b string")
    frame.createOrReplaceTempView("sql_functions")
    got = spark.sql("SELECT graph_terms(t) a, graph_is_locator(t) b, graph_token_estimate(t) c, graph_recency(seen, 86400 * 28, 14.0D) d, graph_event_key('1', t, b) e, graph_slug(t) f FROM sql_functions").collect()
    expected = frame.select(text.terms(F.col("t")), text.is_locator(F.col("t")), text.token_estimate(F.col("t")), scores.recency(F.col("seen"), F.lit(86400 * 28)), log.event_key(F.lit("1"), F.col("t"), F.col("b")), text.slugify(F.col("t"))).collect()
    assert list(map(tuple, got)) == list(map(tuple, expected))

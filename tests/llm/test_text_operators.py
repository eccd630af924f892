"""Operators that look at one text at a time or at counts, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import bpe, license_scan, line_dedup, quality_rules, sharding, token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, coder):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(docs, PATH, public.PATTERN, ids=True).collect())
    expected = Counter()
    for r in docs.collect():
        ids = coder.encode_ordinary(r.text or "")
        expected[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids))] += 1
    assert got == expected


def test_bpe_of_nothing(docs, empty):
    assert bpe.encode(empty, PATH, public.PATTERN).count() == 0


def test_long_words(spark, coder):
    """Words above LONG_WORD bytes, of one letter, of letters that merge at once, of random letters and pieces of tokens."""
    import random

    rng = random.Random(6)
    tokens = [t.decode() for t in bpe.read_ranks(PATH) if t.isalpha() and t.isascii() and len(t) > 2]
    words = ["a" * 1000, "ab" * 300, "é" * 200, "abcabcab" * 50]
    words += ["".join(rng.choice(tokens) for _ in range(rng.randrange(10, 30))) for _ in range(150)]
    words += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(40, 200))) for _ in range(50)]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, text string")
    got = {r.i: list(r.ids) for r in bpe.encode(frame, PATH, public.PATTERN, ids=True).collect()}
    assert got == {i: coder.encode_ordinary(w) for i, w in enumerate(words)}


def test_splitter_equals_the_pattern():
    import random

    import regex

    whole, split = regex.compile(public.PATTERN).findall, bpe.splitter(public.PATTERN)
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(32, 127), 32, 10, 0x4E00])) for _ in range(12))
        assert split(text) == whole(text)


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics(docs):
    for r in quality_rules.judge(docs, prefix="q_").collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == statistics(r.text)
        assert r.N_words is None or isinstance(r.N_words, str)


def test_hosts_that_fail_take_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 50 == 0 else "short", "bad") for i in range(200)] + [(1000 + i, good, "fine") for i in range(200)] + [(3000, good, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (False, False) and got[1] == (True, False) and got[1000] == (False, True) and got[3000] == (False, True)


def test_rules_of_nothing(empty):
    assert quality_rules.judge(empty).count() == 0


def expected_lines(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if k)
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < least]
        out[(r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


def test_line_dedup(spark, docs, empty):
    expected = expected_lines(docs.collect(), 10)
    row = lambda r: (r.doc_id, r.text, r.n_lines, r.n_dropped)
    assert Counter(map(row, line_dedup.drop_lines(docs).collect())) == expected
    assert Counter(map(row, line_dedup.drop_lines(docs, broadcast_bytes=0).collect())) == expected
    assert line_dedup.drop_lines(empty).count() == 0


def test_insertions_can_be_undone(spark, docs):
    more = docs.filter("doc_id < 7")
    before = line_dedup.reference_counts(docs)
    after = line_dedup.add(line_dedup.add(before, more), more, -1)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before.collect()))


def test_lines_that_given_counts_do_not_have_stay(spark):
    held = line_dedup.digest(b"common")
    made = line_dedup.Cuckoo([held])
    chance = next(x for x in (f"line {i}" for i in range(10**6)) if line_dedup.digest(x.encode()) in made)
    counts = spark.createDataFrame([(bytearray(held), 10)], "key binary, documents long")
    new = spark.createDataFrame([(1, f"common\n{chance}\nend")], "doc_id long, text string")
    for limit in (64 << 20, 0):
        assert line_dedup.drop_lines(new, counts, shards=1, broadcast_bytes=limit).first().text == f"{chance}\nend"


def test_restored_filter_keeps_its_keys():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(100)]
    more = [hashlib.md5(f"y{i}".encode()).digest() for i in range(1000)]
    raw = line_dedup.Cuckoo(keys).to_bytes()
    again = line_dedup.Cuckoo.from_bytes(raw, keys)
    for k in more:
        again.insert(k)
    assert all(k in again for k in [*keys, *more]) and again.remove(keys[0])
    with pytest.raises(ValueError):
        line_dedup.Cuckoo.from_bytes(raw).insert(more[0])


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    made = line_dedup.Cuckoo(keys)
    assert all(k in made for k in keys)
    assert sum(hashlib.md5(f"x{i}".encode()).digest() in made for i in range(5000)) < 25
    for k in keys[:2500]:
        assert made.remove(k)
    assert all(k in made for k in keys[2500:]) and sum(k in made for k in keys[:2500]) < 25
    again = line_dedup.Cuckoo.from_bytes(made.to_bytes())
    assert all(k in again for k in keys[2500:])


def store_of(store):
    """Counts by key and what the filters hold, as plain values."""
    counts = {bytes(r.key): r.documents for r in store.counts.collect()}
    held = {r.shard: line_dedup.Cuckoo.from_bytes(bytes(r.cells)) for r in store.filters.collect()}
    shard = lambda k: int.from_bytes(k[12:14], "big") % store.shards
    return counts, {k for k in counts if shard(k) in held and k in held[shard(k)]}


def test_store_takes_documents_in_and_out(spark):
    """Insertions beyond a filter's growth and deletions, against counts made anew."""
    make = lambda lo, hi: spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i % 7, 400, 1 + i % 3))) for i in range(lo, hi)], "doc_id long, text string")
    start = line_dedup.Store.of(make(0, 6), min_documents=4, shards=3)
    more = start.insert(make(6, 30))
    less = more.delete(make(6, 20))
    for store, docs in ((start, make(0, 6)), (more, make(0, 30)), (less, make(0, 6).unionAll(make(20, 30))), (less.delete(make(20, 30)), make(0, 6))):
        counts, held = store_of(store)
        expected = Counter(line_dedup.digest(k) for r in docs.collect() for k in {line_dedup.line_key(x.encode()) for x in r.text.split("\n")})
        assert counts == dict(expected)
        frequent = {k for k, c in expected.items() if c >= 4}
        assert frequent <= held and len(held - frequent) <= 3
        kept = Counter((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_lines(docs, store=store).collect())
        assert kept == Counter((d, t, n - len(t.split("\n")) if t else n) for d, t, n in ((r.doc_id, "\n".join(x for x in r.text.split("\n") if expected[line_dedup.digest(x.encode())] < 4), len(r.text.split("\n"))) for r in docs.collect()))
    assert store_of(less.delete(make(0, 6)).delete(make(20, 30)))[0] == {}


def test_columns_may_have_any_names(spark, coder):
    from pyspark.sql import functions as F

    names = ["_copies", "_bucket", "_n", "_before", "_within", "_copy", "_number", "_total", "_place", "_row", "_drop", "_host", "_bad", "_key", "c0", "p", "words", "rows", "tables", "key", "row"]
    frame = spark.createDataFrame([(i, f"some words {i % 2}\nline", "h") for i in range(12)], "doc_id long, text string, source string").select("*", *(F.lit("x").alias(n) for n in names))
    assert {r.shard for r in sharding.shard(frame, 3).collect()} == {0, 1, 2}
    assert quality_rules.judge(frame).columns[:24] == frame.columns
    for limit in (64 << 20, 0):
        assert {r.text for r in line_dedup.drop_lines(frame, broadcast_bytes=limit).collect()} == {"some words 0", "some words 1"}
    assert {tuple(r.ids) for r in bpe.encode(frame, PATH, public.PATTERN, ids=True).collect()} == {tuple(coder.encode_ordinary(f"some words {i}\nline")) for i in (0, 1)}


def test_written_shards(spark, tmp_path, docs):
    sharding.write_shards(docs, f"{tmp_path}/s", 5)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))


def test_sharding_against_plain_python(spark):
    """Sizes and checksums of the query, and each slot from the row number by the permutation."""
    import zlib

    from graphloom.llm import queries

    rows = [(i, t) for i, t in enumerate(["a", "", None, "é漢", "x" * 70000, "a", "a"])]
    got = sorted(tuple(r) for r in (lambda d: sharding.shard(d, 3).collect())(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((p, s) for *_, p, s in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    for r in queries.QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect():
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_license_scan(docs, spark, empty):
    more = spark.createDataFrame([(1, "MIT license, mit LICENSE cc by; cc by-nc Apache  License mit"), (2, "é GNU general. public license"), (3, None), (3, None), (None, "Licensed under the new apache license version 2 0")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), more):
        expected = Counter()
        for r in frame.collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
            places = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            expected[(r.doc_id, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
        got = license_scan.scan(frame).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    labels = {r.doc_id: r.labels for r in license_scan.scan(more).collect()}
    assert labels[None] == "apache,apache-2.0"  # a word more in between
    assert license_scan.scan(empty).count() == 0


def test_shards(docs, empty, spark):
    got = sharding.shard(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(docs.repartition(7), 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, sharding.shard(docs, 4, seed=1).collect()))
    assert sharding.shard(empty, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select(sharding.permute(F.col("id"), F.lit(n).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_token_counts(docs, coder, empty):
    lengths = sorted(len(coder.encode_ordinary(r.text or "")) for r in docs.collect())
    sums = token_counts.count(docs, PATH, public.PATTERN)
    for r in sums.collect():
        assert r.tokens_truncated == sum(min(x, r.length) for x in lengths)
        assert r.docs_at_least == sum(x >= r.length for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.length)
        assert r.quantile == sum(x <= r.length for x in lengths) / len(lengths)
    for limit in (0, 10, 10**6):
        got = token_counts.truncated_total(sums, limit).first()
        assert (got.total, got.cut) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    assert token_counts.count(empty, PATH, public.PATTERN).count() == 0

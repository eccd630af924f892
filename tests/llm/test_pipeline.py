"""The pipeline against its stages one after the other and against plain Python, and the queries of the operators with SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, sizes = docs.count(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < start
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.text, r.n_tokens, r.ids_sha256)
    assert Counter(map(key, whole.collect())) == Counter(map(key, docs.collect()))
    for r in docs.collect():
        assert r.n_chars == len(r.text) and r.n_tokens == len(r.ids)


def test_pipeline_against_plain_python(spark, tmp_path):
    """All stages worked out again without Spark, on documents that meet every stage, with nulls, repeated rows and columns of clashing names."""
    import hashlib
    import random
    import re

    import numpy as np
    import public_tokenizers
    import tiktoken

    from graphloom.llm import bpe

    rng = random.Random(31)
    words = lambda n: [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10)}" for _ in range(n)]
    item = " ".join(words(30))
    texts = []
    for i in range(90):
        body = words(rng.randrange(60, 120))
        if i % 9 == 0:
            body = words(20)  # too short
        elif i % 9 == 1:
            body = words(4) * 20  # repeats
        if i % 15 == 7:
            body[10:10] = item.split()
        lines = [" ".join(body[a : a + 12]) for a in range(0, len(body), 12)]
        texts.append("\n".join([*lines, " Subscribe to our letter "] if i % 3 == 0 else lines))
    texts += [texts[2], texts[3] + " end", None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), "x", "y") for i, t in enumerate(texts)] + [(2, texts[2], "en", "s2", 1, "x", "y"), (None, texts[5], "en", None, 1, "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def passes(t):
        w = split(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    docs = [(r[0], r[1]) for r in rows if passes(r[1])]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    counts = Counter(k for _, t in docs for k in {key(x) for x in t.split("\n")} if k)
    docs = [(d, "\n".join(x for x in t.split("\n") if counts[key(x)] < 10)) for d, t in docs]
    assert counts["subscribe to our letter"] >= 10
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (split(t.lower()) for _, t in docs)]
    group = list(range(len(docs)))
    for _ in docs:
        for a in range(len(docs)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    groups = {}
    for g, d in zip(group, docs):
        groups.setdefault(g, []).append(d)
    assert max(map(len, groups.values())) >= 3
    clean = [g for g in groups.values() if not any(item in " ".join(split(t)) for _, t in g)]
    assert 0 < len(clean) < len(groups)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.tokenizer()[0]), special_tokens={})
    assert len(got) == len(clean)
    for members in clean:
        mine = [r for r in got if (r.doc_id, r.text) in members]
        assert len(mine) == 1
    for r in got:
        ids = coder.encode_ordinary(r.text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.n_chars == len(r.text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_in_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    found = con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert Counter(tuple(r[c] for c in names) for r in frame.collect()) == Counter(tuple(r[columns.index(c)] for c in names) for r in found.fetchall())


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]

"""Operators that compare texts, against brute force and planted cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import decontamination, jaccard, quality_classifier, substring_dedup
from graphloom.operators.components import connected

SYLLABLES = "ba ko ri te mu lo na si do ve".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def find_components(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and den * common >= num * len(sets[x] | sets[y]):
                parent[top(x)] = top(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[top(x)].append(x)
    out = Counter()
    for members in groups.values():
        ids = [rows[x][0] for x in members if rows[x][0] is not None]
        out.update((rows[x][0], len(sets[x]), min(ids) if ids else None) for x in members)
    return out


def edited(rng, n):
    base = [[rng.choice("abcdefghij") * 2 + str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))] for _ in range(10)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = "w" + str(rng.randrange(6))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small_cells", [False, True])
def test_jaccard_join(spark, monkeypatch, small_cells):
    if small_cells:  # the recursion
        monkeypatch.setattr(jaccard, "LEAF_PAIRS", 2)
        monkeypatch.setattr(jaccard, "LEAF_EACH", 0)
    rows = edited(random.Random(5), 250)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.components(frame, k=2, similarity=(80, 100)).collect())
    assert got == find_components(rows, 2, 80, 100)


def test_jaccard_join_of_odd_rows(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.components(docs, k=4, similarity=(85, 100)).collect())
    assert got == find_components(rows, 4, 85, 100)
    assert jaccard.components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 102").count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {x: top(x) for x in parent}


def test_passages_are_found_and_clean_texts_left(spark, empty):
    rng = random.Random(3)
    clean = [[word(rng) for _ in range(rng.randrange(60, 300))] for _ in range(300)]
    passages = [[word(rng) for _ in range(rng.randrange(51, 70))] for _ in range(20)]
    planted = defaultdict(list)
    for i in range(0, 300, 3):
        at = rng.randrange(len(clean[i]))
        clean[i][at:at] = passages[i // 3 % 20]
        planted[i // 3 % 20].append(i)
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = substring_dedup.passages(frame).collect()
    texts = {i: t.encode() for i, t in rows}
    for s in spans:
        assert texts[s.doc_id][s.start : s.end] == texts[s.first_doc_id][s.first_start : s.first_start + s.end - s.start]
    later = {i for ids in planted.values() for i in sorted(ids)[1:]}
    found = {s.doc_id for s in spans}
    assert not found - later
    assert len(later - found) <= 0.05 * len(later)
    removed = {r.doc_id: r.text for r in substring_dedup.remove(frame, spark.createDataFrame(spans)).collect()}
    assert all(removed[i] == t for i, t in rows if i not in found) and all(len(removed[i]) < len(dict(rows)[i]) for i in found)
    assert substring_dedup.passages(empty).count() == 0


def repeated_bytes(rows, least):
    """Byte places of each later document that lie in a stretch of at least `least` bytes which an earlier document has, by brute force."""
    seen, out = set(), defaultdict(set)
    for d, text in sorted(rows):
        raw = text.encode()
        windows = [raw[a : a + least] for a in range(len(raw) - least + 1)]
        for a, w in enumerate(windows):
            if w in seen:
                out[d].update(range(a, a + least))
        seen.update(windows)
    return out


def test_passages_against_brute_force(spark):
    """Share of the bytes of repeated stretches that are reported, and that nothing else is."""
    rng = random.Random(21)
    words = lambda n: " ".join(word(rng) for _ in range(n))
    shared = [words(rng.randrange(55, 140)) for _ in range(12)]
    rows = [(i, " ".join([words(rng.randrange(20, 120)), *(rng.choice(shared) for _ in range(rng.randrange(3))), words(rng.randrange(20, 120))])) for i in range(160)]
    rows += [(1000, rows[7][1]), (1001, shared[0])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, digest int").repartition(5)
    spans = substring_dedup.passages(frame).collect()
    found = defaultdict(set)
    for s in spans:
        found[s.doc_id].update(range(s.start, s.end))
    true = repeated_bytes(rows, 250)  # over 50 words of five bytes
    whole = sum(map(len, true.values()))
    assert sum(len(found[d] & p) for d, p in true.items()) >= 0.93 * whole
    assert {d for d in found if found[d]} <= set(repeated_bytes(rows, 60))
    some = repeated_bytes(rows, 20)
    assert all(found[d] <= some[d] for d in found)


def test_passages_of_odd_rows(spark):
    rng = random.Random(22)
    text = " ".join(word(rng) for _ in range(90))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, " ".join(word(rng) for _ in range(40000)) + " " + text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.passages(frame).collect()
    # a null id is the smallest; a repeated row is the same document
    assert {s.doc_id for s in spans} == {3, 4} and {s.first_doc_id for s in spans} == {None}
    back = substring_dedup.remove(frame, spark.createDataFrame(spans, "doc_id long, start long, end long, n_words long, first_doc_id long, first_start long"))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in back.collect())[:3] == [(0, len(text)), (1, 0), (2, 0)]


def test_repeated_units_are_found(spark):
    rng = random.Random(12)
    around = lambda: " ".join(word(rng) for _ in range(rng.randrange(40, 90)))
    units = ["and", "be", "x", "of the", "sia lo", "one two three four five six"]
    rows = []
    for u, unit in enumerate(units):
        for i in range(4):
            rows.append((10 * u + i, f"{around()} {' '.join([unit] * (70 + 9 * i))} {around()}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.passages(frame).collect()
    texts = {i: t.encode() for i, t in rows}
    assert all(texts[s.doc_id][s.start : s.end] == texts[s.first_doc_id][s.first_start : s.first_start + s.end - s.start] for s in spans)
    assert {s.doc_id for s in spans} == {i for i, _ in rows if i % 10}
    few = spark.createDataFrame([(1, "and " * 5), (2, around() + " and" * 80)], "doc_id long, text string")
    assert substring_dedup.passages(few).count() == 0


def test_an_earlier_sentence_does_not_break_a_passage(spark):
    rng = random.Random(13)
    words = lambda n: [word(rng) for _ in range(n)]
    rows, later = [], set()
    for i in range(0, 300, 3):
        passage = words(55)
        rows.append((i, " ".join([*words(60), *passage[15:40], *words(60)])))
        rows += [(i + j, " ".join([*words(60), *passage, *words(60)])) for j in (1, 2)]
        later.add(i + 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.passages(frame).collect()
    texts = {i: t.encode() for i, t in rows}
    assert all(texts[s.doc_id][s.start : s.end] == texts[s.first_doc_id][s.first_start : s.first_start + s.end - s.start] for s in spans)
    assert len(later - {s.doc_id for s in spans}) <= 0.05 * len(later)


def test_an_insertion_moves_few_cuts():
    import numpy as np

    rng = random.Random(1)
    text = " ".join(word(rng) for _ in range(2000)).encode()
    other = text[:3000] + b"inserted" + text[3000:]
    digests = lambda t: {int(x) for x in substring_dedup.chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[3]}
    assert len(digests(text) - digests(other)) <= 3


def test_reparameterised_questions(spark, docs, empty):
    items = spark.createDataFrame([(1, "Yesterday Alice bought 12 apples and gave 5 of them to Robert, so how many apples does Alice have left after 3 days"), (2, "one two"), (3, None), (4, "capital of france is?")], "item_id long, text string")
    rows = [
        (1, "Start. Yesterday Mary bought 20 apples and gave 7 of them to Peter, so how many apples does Mary have left after 9 hours"),
        (2, "Start. Yesterday Mary bought 20 apples and gave 7 of them to Peter, so how many apples does Susan have left after 9 days"),
        (3, None),
        (4, ""),
        (5, "we ask: capital of france is"),
        (6, "one two"),
        (None, "yesterday Bob bought 1 apples and gave 2 of them to Ann, so how many apples does Bob have left after 3 days"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, items).collect()} == {(1, 1), (5, 4), (None, 1)}
    assert {r.doc_id for r in decontamination.drop_leaks(frame, items).collect()} == {2, 3, 4, 6}
    assert {r.doc_id for r in decontamination.drop_leaks(frame, items, broadcast_rows=0).collect()} == {2, 3, 4, 6}
    assert decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(frame, items.limit(0)).count() == 0


def test_letter_case_does_not_hide_an_item(spark):
    items = spark.createDataFrame([(1, "Yesterday Élodie bought 12 apples and gave 5 of them to Robert, so how many does she keep"), (2, "Kim has seven red balls and Alice takes 3 away"), (3, "Who wrote the old song")], "item_id long, text string")
    rows = [
        (1, "NOTE. YESTERDAY ÉLODIE BOUGHT 12 APPLES AND GAVE 5 OF THEM TO ROBERT, SO HOW MANY DOES SHE KEEP"),
        (2, "note. yesterday élodie bought 40 apples and gave 7 of them to robert, so how many does she keep"),
        (3, "They ask (Kim has seven red balls and Mary takes 4 away) in class"),
        (4, "We hear: who sang, Who wrote the old song, and why"),
        (5, "they ask kim had seven red balls and mary takes 4 away in class"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, items).collect()} == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_one_altered_value_does_not_hide_the_rest(spark):
    rng = random.Random(9)
    words = [word(rng) for _ in range(56)]
    verbatim = [*words[:20], "10", *words[20:36], "10", *words[36:]]
    altered = [*verbatim[:37], "12", *verbatim[38:]]
    parted = [*altered[:29], "other", *altered[30:]]  # two runs, each consistent
    items = spark.createDataFrame([(1, " ".join(verbatim)), (2, "we bought 12 red apples and then 5 green apples at the old market")], "item_id long, text string")
    rows = [(1, " ".join(altered)), (2, "Now we bought 7 red apples and then 7 green apples at the old market"), (3, " ".join(parted))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_slots, r.first_token) for r in decontamination.leaks(frame, items).collect()}
    assert got == {(1, 1): (37, 1, 0), (2, 2): (14, 2, 1), (3, 1): (29, 1, 0)}


def test_items_of_placeholders_are_found_word_for_word(spark):
    items = spark.createDataFrame([(1, "Compute 12 45 78 plus 33 9"), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (3, "Present were Ann Bob Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lea")], "item_id long, text string")
    rows = [
        (1, "Please compute 12 45 78 plus 33 9 now"),
        (2, "Please compute 12 45 78 plus 33 8 now"),
        (3, "so 1 2 3 4 5 6 7 8 9 10 11 12 13 14 it goes"),
        (4, "so 2 4 6 8 10 12 14 16 18 20 22 24 26 28 it goes"),
        (5, "it says present were ann bob carl dora emil fritz gerd hans ida jan karl lea there"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_names_that_open_sentences(spark):
    items = spark.createDataFrame([(1, "Alice has 3 red apples. Bob gives Alice 4 more. How many does Alice have now?"), (2, "Alice bought 12 apples at the market today."), (3, "What is the capital of France?"), (4, "What is 3 + 4 * 5 - 6 / 7 + 8 - 9?")], "item_id long, text string")
    rows = [
        (1, "Mary has 5 red apples. Tom gives Mary 6 more. How many does Mary have now?"),
        (2, "Mary bought 15 apples at the market today."),
        (3, "Paris is the capital of France."),
        (4, "Then: what is 3 + 4 * 5 - 6 / 7 + 8 - 9?"),
        (5, "Mary has 5 red apples. Tom gives Susan 6 more. How many does Peter have now?"),
        (6, "She bought 15 apples at the market today."),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, items).collect()} == {(1, 1), (2, 2), (4, 4)}


def brute_leaks(texts, items, k=8, least=13):
    """(doc, item) where a stretch of equal lower-cased tokens holds least tokens of the item, or all of a shorter one: what must be found in any case."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    out = set()
    for d, text in texts:
        t = tokens(text)
        for i, item in items:
            v = tokens(item)
            need = min(least, len(v))
            if need >= 3 and any(t[a : a + need] == v[b : b + need] for b in range(len(v) - need + 1) for a in range(len(t) - need + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    """Texts of few words, capitals and numbers at random, so that partial passages of all lengths occur; repeated rows, ties, clashing columns."""
    rng = random.Random(17)
    pick = lambda: rng.choice([word(rng), word(rng).capitalize(), str(rng.randrange(50)), "Ann", "the"])
    items = [(i, " ".join(pick() for _ in range(rng.choice([2, 3, 5, 8, 13, 14, 20, 40])))) for i in range(30)] + [(30, None), (31, "")]
    texts = []
    for d in range(120):
        body = [pick() for _ in range(rng.randrange(0, 60))]
        source = items[rng.randrange(30)][1].split()
        a = rng.randrange(len(source))
        at = rng.randrange(len(body) + 1)
        body[at:at] = source[a : a + rng.randrange(1, len(source) + 1)]
        texts.append((d, " ".join(body)))
    texts += [texts[3], (500, None), (501, ""), (502, "x " * 30000 + items[5][1])]
    frame = spark.createDataFrame([(d, t, "a", "b") for d, t in texts], "doc_id long, text string, key string, item string").repartition(3)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()}
    expected = brute_leaks(texts, items)
    assert expected - got == set()
    # what is found besides is a template: the same words but for numbers and names
    plain = lambda t: re.sub(r"\b([A-Z]\w*|\d+)\b", "0", t or "")
    masked = brute_leaks([(d, plain(t)) for d, t in texts], [(i, plain(t)) for i, t in items])
    assert got - expected <= masked
    kept = decontamination.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got}


def test_benchmark_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(word(rng) for _ in range(30))) for i in range(20)]
    rows = [(i, " ".join(word(rng) for _ in range(50)) + (" " + items[i][1] if i < 10 else "")) for i in range(40)]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK", 100)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()} == {(i, i) for i in range(10)}


def test_classifier(spark, docs, empty):
    import zlib

    rng = random.Random(4)
    good = lambda: " ".join(word(rng) for _ in range(100)) + "."
    bad = lambda: " ".join(word(rng).upper() + "!!" for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(1000, None), (1001, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_classifier.train(frame, labels)
    scored = {r.doc_id: r for r in quality_classifier.score(frame, rules).collect()}
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i].held_out for i in held)
    assert sum(scored[i].predicted == (1 if i % 4 else 0) for i in held) >= 0.98 * len(held)
    nothing = quality_classifier.train(frame, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, nothing).collect()} == {0.5}
    assert quality_classifier.score(empty, rules).count() == 0


def test_scores_against_plain_python(spark, docs):
    """Features and rule sums of every row, worked out again; ties, repeated rows, long texts and clashing columns among them."""
    import math
    import zlib
    from collections import Counter as C

    rules = quality_classifier.Rules(0.3, [1.5, -2.0, 0.7, 0.25, -0.4], [((0, False, 5.0),), ((5, False, 0.1), (1, True, 6.0)), ((8, False, 0.0),), ((4, True, 0.2), (3, True, 0.0), (2, True, 0.0)), ((6, False, 0.05), (7, True, 0.5))])

    def values(text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = C(zip(w, w[1:], w[2:]))
        covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        per = lambda x, n: x / n if n else 0.0
        count = lambda chars, n: per(sum(c in chars for c in t), n)
        return [float(len(w)), per(sum(map(len, w)), len(w)), per(sum(c in "#*$%&|<>" for c in t), len(w)), per(len(lines) - len(set(lines)), len(w)), per(len(covered), len(w)), count(quality_classifier.UPPER, len(t)), count("0123456789", len(t)), count("!?", len(w)), count("\n", len(w))]

    expected = C()
    for r in docs.collect():
        x = values(r.text)
        total = rules.intercept + sum(w for w, rule in zip(rules.weights, rules.rules) if all((x[f] <= limit) == below for f, below, limit in rule))
        score = 1 / (1 + math.exp(-total))
        held = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0
        expected[(r.doc_id, held, round(score, 12), int(score >= 0.3))] += 1
    got = C((r.doc_id, r.held_out, round(r.score, 12), r.predicted) for r in quality_classifier.score(docs, rules).collect())
    assert got == expected
    assert quality_classifier.features(docs).columns == [*docs.columns, "features"]

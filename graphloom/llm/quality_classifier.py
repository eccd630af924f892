"""Quality classifier: a sparse rule ensemble.

Statistics of each text feed small boosted trees on a bounded sample of labelled rows. Every path from a root to a node becomes a
conjunctive rule; logistic weights of all rules are fitted with an L1 penalty, which leaves few rules. The rules that stay are compiled
into one Spark column expression over the statistics, so scoring needs no model object on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import quality_rules
from graphloom.llm.shared import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Inputs of the rules; shares are 0 for texts without words.
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "lines"]

#: A condition is (feature index, true for <=, threshold); a rule is a tuple of conditions.
Rule = tuple[tuple[int, bool, float], ...]


def features(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all by default) with the FEATURES as doubles, in one struct column `features` of that order. A null text is an empty one.

    What Spark counts in a text is counted before the text goes to Python, so only carried columns come back.
    """
    carry = docs.columns if carry is None else carry
    names = {c: fresh(docs, "_" + c) for c in quality_rules.STATISTICS}
    body = F.coalesce(F.col(text), F.lit(""))
    length = F.length(body)
    without = lambda chars: length - F.length(F.translate(body, chars, ""))
    per = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    counts = {fresh(docs, n): v for n, v in (("_capitals", without(UPPER)), ("_digits", without("0123456789")), ("_marks", without("!?")), ("_lines", without("\n")), ("_length", length))}
    capitals, digits, marks, lines, chars = map(F.col, counts)
    found = quality_rules.statistics(docs.select("*", *(v.alias(n) for n, v in counts.items())), text, names, [*carry, *counts])
    words = F.col(names["n_words"])
    values = [
        words.cast("double"),
        per(F.col(names["word_chars"]), words),
        per(F.col(names["n_symbols"]), words),
        per(F.col(names["n_dup_lines"]), words),
        per(F.col(names["n_repeat_words"]), words),
        per(capitals, chars),
        per(digits, chars),
        per(marks, words),
        per(lines, words),
    ]
    return found.select(*carry, F.struct(*(v.alias(n) for v, n in zip(values, FEATURES))).alias("features"))


@dataclass
class Rules:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    weights: list[float]
    rules: list[Rule]

    def column(self, struct: str = "features") -> Column:
        total = F.lit(self.intercept)
        for weight, rule in zip(self.weights, self.rules):
            holds = F.lit(True)
            for f, below, limit in rule:
                value = F.col(struct)[FEATURES[f]]
                holds = holds & ((value <= limit) if below else (value > limit))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int, columns: np.ndarray) -> tuple[float, int, float] | None:
    """The split (gain, feature, threshold) of the greatest gain, or None."""
    best = None
    base = g.sum() ** 2 / (h.sum() + 1)
    for f in columns:
        limits = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33)))
        below = x[:, f][:, None] <= limits
        n = below.sum(0)
        gl, hl = g @ below, h @ below
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
        gain[(n < least) | (len(g) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), int(f), float(limits[k]))
    return best


def _grow(x, g, h, depth, least, rng, path: Rule, rules: dict[Rule, None]) -> np.ndarray:
    """Adds the paths of a new tree to rules; returns the tree's values."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1))
    columns = rng.choice(x.shape[1], max(1, (2 * x.shape[1]) // 3), replace=False)
    found = _split(x, g, h, least, columns) if depth and len(g) >= 2 * least else None
    if found:
        _, f, limit = found
        below = x[:, f] <= limit
        for side, low in ((below, True), (~below, False)):
            step = (*path, (f, low, limit))
            rules[step] = None
            out[side] = _grow(x[side], g[side], h[side], depth - 1, least, rng, step, rules)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Logistic weights of 0/1 columns with an L1 penalty, by accelerated proximal gradients."""
    n, m = r.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    size = 4.0 / (1 + (np.linalg.norm(r, 2) ** 2 / n if m else 0))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y
        new_w = v - size * (r.T @ e / n)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - size * penalty, 0)
        new_b = c - size * e.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-4, seed: int = 7) -> Rules:
    """Rules for feature rows x and labels y; without both labels a constant (0.5 without any)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))), [], [])
    rng = np.random.default_rng(seed)
    found: dict[Rule, None] = {}
    score = np.zeros(len(y))
    for _ in range(trees):
        pick = rng.random(len(y)) < 0.7
        p = 1 / (1 + np.exp(-score))
        grown: dict[Rule, None] = {}
        if pick.sum() >= 4:
            values = _grow(x[pick], (p - y)[pick], (p * (1 - p))[pick], depth, max(2, int(0.002 * len(y))), rng, (), grown)
            score[pick] += 0.3 * values
        found |= grown
    rules = list(found)
    holds = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for f, below, limit in rule:
            holds[:, k] *= (x[:, f] <= limit) == below
    _, first = np.unique(holds, axis=1, return_index=True)  # rules that hold on the same rows are one
    pick = np.sort(first)
    b, w = _lasso(holds[:, pick], y, penalty)
    stays = np.flatnonzero(w != 0)
    return Rules(float(b), [float(w[k]) for k in stays], [rules[pick[k]] for k in stays])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's decimal text mod 5 is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000) -> Rules:
    """Learns from at most `sample` labelled rows that are not held out, those of the least id hashes.

    This bound is the only limit: the driver fits on sample rows of FEATURES. Labels other than 0 and 1 and null ids are no labels.
    """
    use = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
    use = use.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(use), "_id")
    got = features(rows.select("_id", "_y", "_text"), "_text", ["_id", "_y"]).select("_id", "_y", *(F.col("features")[n].alias(n) for n in FEATURES)).orderBy(F.xxhash64("_id"), "_id", "_y", *FEATURES).limit(sample).toPandas()
    return fit(got[FEATURES].to_numpy(np.float64).reshape(-1, len(FEATURES)), got["_y"].to_numpy(np.float64))


def score(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored by features that are all 0."""
    out = features(docs.select("doc_id", "text"), "text", ["doc_id"])
    scored = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

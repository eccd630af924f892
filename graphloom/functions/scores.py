"""Column functions of scores, counters and provenance."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Config
from graphloom.model import COMPOSE, CONFIDENCE, PREFIX_TAGS, SIGNATURES, TIERS


def rank_of(confidence: Column) -> Column:
    """Place of a confidence in the ladder; unknown ones are at the bottom."""
    return F.greatest(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence) - 1, F.lit(0)).cast("int")


def confidence_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank + 1).cast("int"))


def tags(family: Column, kind: Column) -> Column:
    return F.when(family.isNull(), F.array().cast("array<string>")).when(kind.isNull(), F.array(family)).otherwise(F.array(family, F.concat_ws("/", family, kind)))


def id_tags(node_id: Column) -> Column:
    found = F.create_map(*(x for k, v in PREFIX_TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(found, F.split_part(node_id, F.lit(":"), F.lit(1))), F.array().cast("array<string>"))


def well_typed(relation: Column, source: Column, target: Column) -> Column:
    """Whether tags source and target fit the relation's signature; relations without one always fit."""
    side = lambda k: F.create_map(*(x for r, s in SIGNATURES.items() for x in (F.lit(r), F.array(*map(F.lit, s[k])))))
    fits = lambda k, t: F.coalesce(F.arrays_overlap(F.try_element_at(side(k), relation), t), F.lit(False))
    return ~relation.isin(*SIGNATURES) | (fits(0, source) & fits(1, target))


def compose_chain(relations: Column) -> Column:
    """Left fold of the composition over an array of relations; null where a step does not compose, or for none."""
    table = F.create_map(*(F.lit(x) for (a, b), c in COMPOSE.items() for x in (f"{a} {b}", c)))
    rest = F.slice(relations, 2, F.greatest(F.size(relations) - 1, F.lit(0)))
    return F.when(F.size(relations) > 0, F.aggregate(rest, F.try_element_at(relations, F.lit(1)), lambda acc, r: F.try_element_at(table, F.concat(acc, F.lit(" "), r))))


def path_rank(ranks: Column) -> Column:
    """Rank of a path: the weakest hop, and at most INFERRED for more than one hop; EXTRACTED for none."""
    low = F.coalesce(F.array_min(ranks), F.lit(2))
    return F.when(F.size(ranks) > 1, F.least(low, F.lit(1))).otherwise(low)


def tier(family: Column, kind: Column, grounding: Column, attestation: Column) -> Column:
    return (
        F.when(attestation == "human", "human")
        .when(family == "intent", "must")
        .when((family == "memory") & (grounding == "empirical"), "empirical")
        .when((family == "memory") & kind.isin("decision", "constraint"), "architectural")
        .when(family == "plan", "plan-assumption")
        .when(family == "structure", "structural")
        .otherwise("llm")
    )


def tier_rank(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TIERS)), name)
    return F.when(at > 0, at - 1).otherwise(len(TIERS)).cast("int")


def normalize(value: Column, over: Window) -> Column:
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi - lo < 1e-12, 0.0).otherwise((value - lo) / (hi - lo))


def recency(last_seen: Column, now: Column, half_life_days: float = DEFAULTS.half_life_days) -> Column:
    age = F.greatest((now - last_seen) / 86400.0, F.lit(0.0))
    return F.when(F.coalesce(last_seen, F.lit(0)) == 0, 0.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def relevance(refs: Column, recent: Column, maturity: Column, superseded: Column, c: Config = DEFAULTS) -> Column:
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return c.w1 * F.log(1.0 + refs) + c.w2 * recent + c.w3 * flag(maturity == "settled") - c.w5 * flag(maturity == "proposed") - c.w4 * flag(superseded > 0)


def maturity_verdict(maturity: Column, upholds: Column, superseded: Column, survival: Column, measurable: Column, c: Config = DEFAULTS) -> Column:
    stays = (maturity == "proposed") & (upholds < c.maturity_confirm)
    settled = (upholds >= c.maturity_k) & (superseded == 0) & (~measurable | (survival >= c.survival_floor))
    return F.when(stays, "proposed").when(settled, "settled").otherwise("working")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def greedy_fill(costs: Column, budget: int) -> Column:
    """Indexes (from 0) of the entries that fit, taken in order, skipping those that do not."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(s: Column, cost: Column) -> Column:
        fits = s.used + cost <= budget
        return F.struct(F.when(fits, s.used + cost).otherwise(s.used).alias("used"), F.when(fits, F.array_append(s.kept, s.i)).otherwise(s.kept).alias("kept"), (s.i + 1).alias("i"))

    return F.aggregate(costs, start, step, lambda s: s.kept)

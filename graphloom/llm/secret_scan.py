"""Secret scans by character Markov models, with DataFrame functions only.

Rules find the secrets that have a form of their own. The method finds the others: candidates are long runs of the characters that keys and identifiers
are made of. Two Markov chains over these characters, one of random strings and one of ordinary identifiers, are counted from labelled samples,
and a candidate is a secret if its log-likelihood ratio under the two is high enough. The ratio of a pair of characters is a whole number of
thousandths, so that a sum of them is exact.

Places come from splitting a text at its matches: gaps and matches alternate, and their running lengths are the places, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import settled

# The rules, in the order in which kinds are listed, with the group that holds the secret and its least length. A run with a
# least length is the same search as any run of which the short ones are dropped, as runs end at the same places; an assignment
# that is dropped still takes its characters, so short ones are searched for too.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What the models call their spans; it is listed after the rules' kinds.
KIND = "markov"
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
#: Characters that the chains know, for the smoothing: letters, digits and the six others of rules and candidates.
SYMBOLS = 68
#: Matches of a text whose places are summed one by one; blocks of them are then moved by their offsets.
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, whatever number of times body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(steps: Column) -> Column:
    """Array of (start, end, value) of steps (gap, size, value): running sums, in blocks so that long arrays are not copied for each element."""
    row = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(row)

    def block(part: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            end = start + s["size"]
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value")))).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["value"].alias("value")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: block(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(_let(steps, blocks), F.struct(F.lit(0).alias("at"), none.alias("out")), join, lambda acc: acc["out"])


def found(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches whose group has at least so many characters; null if there is none."""
    p = F.lit(pattern)
    # the last gap has no match beside it and falls out with its null value
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    steps = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(_places(steps), lambda x: F.length(x["value"]) >= least))


def read(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict = RULES, candidate: str = CANDIDATE) -> DataFrame:
    """keep and `found`: a struct with the places of each rule and of the candidates, one pass over the texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    places = [found(whole, *rule).alias(kind) for kind, rule in rules.items()]
    return docs.select(*(keep or []), F.struct(*places, found(whole, candidate).alias(KIND)).alias("found"))


def samples(spans: DataFrame, rules: dict = RULES) -> DataFrame:
    """token, random: the labelled samples of a corpus. What a rule has found is random, candidates that are no rule's value are ordinary; a text's equal tokens count once."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    values = lambda k: F.coalesce(F.col(f"found.{k}"), none)["value"]
    secret = F.array_distinct(F.concat(*(values(k) for k in rules)))
    each = spans.select(F.transform(secret, lambda t: F.struct(t.alias("token"), F.lit(True).alias("random"))).alias("a"), F.transform(F.array_except(values(KIND), secret), lambda t: F.struct(t.alias("token"), F.lit(False).alias("random"))).alias("b"))
    return each.select(F.explode(F.concat("a", "b")).alias("x")).select("x.*")


def _pairs(token: Column) -> Column:
    """Numbers of the neighbouring characters of an ASCII token: 128 times the first plus the second."""
    chars = F.split(token, "")
    return F.zip_with(F.slice(chars, F.lit(1), F.length(token) - 1), F.slice(chars, F.lit(2), F.length(token) - 1), lambda a, b: F.ascii(a) * 128 + F.ascii(b))


def train(labelled: DataFrame) -> dict[int, int]:
    """Thousandths of the log-likelihood ratio of each pair of characters, random against ordinary, from samples (token, random).

    Each chain's chance of a character after another is its count plus one, over the count of the first plus SYMBOLS, so a sample of one kind only,
    or none, leaves that chain uniform. Counts are of all samples; what comes to the driver is a row for each pair of characters.
    """
    ascii_ = labelled.filter(F.length("token") == F.octet_length("token")).filter(F.length("token") > 1)
    counts = ascii_.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    first = counts.groupBy(F.floor(F.col("pair") / 128).cast("int").alias("first")).agg(F.sum("r").alias("fr"), F.sum("o").alias("fo"))
    ratio = F.log((F.col("r") + 1) / (F.col("fr") + SYMBOLS)) - F.log((F.col("o") + 1) / (F.col("fo") + SYMBOLS))
    both = counts.join(first, F.floor(F.col("pair") / 128) == F.col("first"))
    told = {row.pair: row.score for row in both.select("pair", F.floor(ratio * 1000 + 0.5).cast("int").alias("score")).collect()}
    # a pair that no sample has, after a character that some have
    rest = first.select("first", F.floor((F.log(1 / (F.col("fr") + SYMBOLS)) - F.log(1 / (F.col("fo") + SYMBOLS))) * 1000 + 0.5).cast("int").alias("score")).collect()
    return {row.first * 128 + b: row.score for row in rest for b in range(128)} | told


def score(token: Column, model: dict[int, int]) -> Column:
    """Sum of the model's thousandths along a token; a pair that it does not know counts 0."""
    # one literal: the table is read from a string when the plan is made
    table = F.split(F.lit(",".join(str(model.get(i, 0)) for i in range(128 * 128))), ",").cast("array<int>")
    return F.aggregate(_pairs(token), F.lit(0).cast("long"), lambda acc, p: acc + F.get(table, p))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10_000, rules: dict = RULES, model: dict[int, int] | None = None) -> DataFrame:
    """doc_id, spans: array of (start, rank, end, kind, value), ordered by start and then kind, for every row.

    Spans of the rules are all there; those of the models (kind markov) stand beside them, over them where both find one. least is the log-likelihood
    ratio that makes a candidate a secret, in thousandths. Without a model one is trained on docs. Places count code points, ends are exclusive. A null
    text is an empty one and has no spans; repeated rows give repeated results; a null id is an id; other columns of docs are not read. Texts are read
    once: what they hold is written, and training and scoring read that.
    """
    spans = settled(lambda: read(docs, text, [F.col(doc_id).alias("doc_id")], rules))
    known = model if model is not None else train(samples(spans, rules))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    named = lambda k, rank: F.transform(F.col(f"found.{k}"), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"), x["value"].alias("value")))
    ruled = [F.coalesce(named(k, rank), none) for rank, k in enumerate(rules)]
    scored = F.coalesce(named(KIND, len(rules)), none)
    return spans.select("doc_id", F.array_sort(F.concat(*ruled, F.filter(scored, lambda x: score(x["value"], known) >= least))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

"""Host-level quality rules.

Word statistics give each document a base verdict. Failures are summed by host (source), each host's failure rate is
shrunk toward the mean of all hosts by a beta prior whose strength is fitted to the spread of the rates (method of moments),
and hosts whose shrunk rate is too high lose their other documents as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm import kernel
from graphloom.llm.shared import discard, fresh, materialize, small, text_column

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Index of each element's first equal within its row (its own where there is none)."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    out = np.empty(len(h), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else order
    return out


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The STATISTICS of the texts of one slice."""
    hasher = kernel.Hasher(data)
    found = kernel.words(data, offsets, kernel.BLANK, hasher)
    n_rows = len(offsets) - 1
    chars = _per_row(~kernel.BLANK[data] & ((data & 0xC0) != 0x80), offsets)
    # lines: between row edges and newlines
    cuts = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_rows = np.searchsorted(offsets[1:], begins, "right") if len(data) else np.zeros(len(begins), np.int64)
    # a newline that ends a row's last line opens an empty line of the same row, which has no word
    line_rows = np.minimum(line_rows, n_rows - 1)
    ends = np.append(begins[1:], len(data))
    ends = np.where((ends > begins) & (ends <= len(data)) & (ends > 0) & (data[np.maximum(ends - 1, 0)] == 10 if len(data) else False), ends - 1, ends)
    word_at = np.searchsorted(found.starts, begins)
    has_word = np.append(found.starts, 1 << 62)[word_at] < ends
    b, e, r = begins[has_word], ends[has_word], line_rows[has_word]
    first = _repeats(hasher.of(b, e), r)
    dup_lines = np.bincount(r[first != np.arange(len(first))], minlength=n_rows)
    # words in windows of three that stand twice or more
    hashes, whole = kernel.windows(found, 3)
    at = np.flatnonzero(whole)
    first = _repeats(hashes[at], found.rows[at])
    twice = np.zeros(len(at), bool)
    again = first != np.arange(len(first))
    twice[again] = True
    twice[first[again]] = True
    covered = np.zeros(len(found.starts), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    repeated = np.bincount(found.rows[covered], minlength=n_rows)
    return [np.diff(found.first), chars, _per_row(_SYMBOL[data], offsets), dup_lines, repeated]


def statistics(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all by default) and its STATISTICS (by other names where names has them) as long columns; a null text has none of anything."""
    names, carry = names or {}, docs.columns if carry is None else carry
    out = StructType([*(docs.schema[c] for c in carry), *(StructField(names.get(c, c), LongType()) for c in STATISTICS)])
    arrow = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, offsets in kernel.slices(text_column(batch, text)):
                made = [pa.array(x.astype(np.int64)) for x in statistics_of(data, offsets)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).select(carry).columns, *made], schema=arrow)

    return docs.mapInArrow(run, out)


def base_failed(n_words: F.Column, n_repeat_words: F.Column, min_words: int, max_repeat: int) -> F.Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, docs, failed) to (host, docs, failed, rate): rates shrunk by a beta prior.

    mean = all failures / all documents; variance = the spread of the hosts' rates, weighted by documents, less what chance
    alone gives. strength = mean (1 - mean) / variance - 1, at least 1 and at most 1000 (also where the hosts do not differ
    beyond chance); rate = (failed + strength * mean) / (docs + strength).
    """
    total = failures.agg(F.sum("docs").cast("double").alias("n"), F.sum("failed").cast("double").alias("f"), F.count("*").cast("double").alias("hosts"))
    mean = F.when(F.col("n") > 0, F.col("f") / F.col("n")).otherwise(0.0)
    total = total.withColumn("mean", mean)
    with_mean = failures.crossJoin(F.broadcast(total))  # one row
    gap = F.col("failed") / F.col("docs") - F.col("mean")
    spread = with_mean.agg(F.sum(F.col("docs") * gap * gap).alias("ss"))
    both = total.crossJoin(F.broadcast(spread))
    chance = F.col("mean") * (1 - F.col("mean"))
    variance = (F.coalesce("ss", F.lit(0.0)) - chance * (F.col("hosts") - 1)) / F.greatest(F.col("n"), F.lit(1.0))
    strength = F.when(variance * 1001 <= chance, 1000.0).otherwise(F.greatest(F.lit(1.0), chance / variance - 1))
    prior = both.select("mean", strength.alias("strength"))
    rate = (F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("docs") + F.col("strength"))
    return failures.crossJoin(F.broadcast(prior)).select("host", "docs", "failed", rate.alias("rate"))


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat: int = 50,
    max_host_rate: float = 0.5,
    broadcast_hosts: int = 100_000,
    prefix: str = "",
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds the STATISTICS, base_failed and kept (each name after prefix) to docs, or to its columns carry only.

    kept is false where base_failed, and where the host's shrunk failure rate is above max_host_rate. Documents of a null
    host share one host. A null or empty text has no words and fails. Input columns of the new names are replaced.
    Only the hosts above the limit are joined back: by broadcast up to broadcast_hosts of them, else by a shuffle. The texts are read
    once: the carried columns with the statistics are written, and both the hosts' sums and the result read them.
    """
    names = {c: prefix + c for c in STATISTICS}
    failed, kept = prefix + "base_failed", prefix + "kept"
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {*names.values(), failed, kept}))
    verdict = base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"]), min_words, max_repeat)
    carry = [c for c in docs.columns if carry is None or c in carry]
    mark, bad = fresh(docs, "_host"), fresh(docs, "_bad")
    held = docs.withColumn(mark, F.col(host))
    found = materialize(statistics(held, text, names, [*carry, mark]).withColumn(failed, verdict))
    failures = materialize(found.groupBy(F.col(mark).alias("host")).agg(F.count("*").alias("docs"), F.sum(F.col(failed).cast("long")).alias("failed")))
    rejected = materialize(host_rates(failures).filter(F.col("rate") > max_host_rate).select("host"))
    discard(failures)
    hosts = rejected.select(F.col("host").alias(bad))
    hosts = F.broadcast(hosts) if small(hosts, broadcast_hosts) else hosts
    rest = found.join(hosts, F.col(mark).eqNullSafe(F.col(bad)), "left_semi").select(*carry, *names.values(), failed, F.lit(False).alias(kept))
    stays = found.join(hosts, F.col(mark).eqNullSafe(F.col(bad)), "left_anti").select(*carry, *names.values(), failed, (~F.col(failed)).alias(kept))
    return stays if rejected.isEmpty() else stays.unionByName(rest)

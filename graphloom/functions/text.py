"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How identifiers split, what a locator looks like, alone and inside a text.
_CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
_LOCATOR = r"^(mem|int|task|plan|sym|file|module):"
LOCATOR_IN_TEXT = r"(?:sym|int|mem|task|file|module|plan):[^\s,;()]+"


def terms(text: Column) -> Column:
    """Lower-cased terms of identifiers and prose, split at case changes, digits and other characters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CAMEL), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def slugify(text: Column, words: int = 6) -> Column:
    """The first words, lower-cased and joined by '-', 48 characters at most; 'memory' where nothing is left."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    slug = F.trim(F.substring(F.array_join(F.slice(parts, 1, words), "-"), 1, 48), F.lit("-"))
    return F.when(slug == "", "memory").otherwise(slug)


def is_locator(text: Column) -> Column:
    return text.rlike(_LOCATOR) & ~text.rlike(r"\s")


def explanation_ids(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOCATOR_IN_TEXT), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


def title(text: Column, width: int = 96) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def line_range(target: Column) -> Column:
    """path, first, last of file targets like path:L3-L9 or path:L3-9; no range: nulls."""
    pattern = r"^(.*):L(\d+)-L?(\d+)$"  # fixed value
    hit = target.rlike(pattern)
    part = lambda k: F.regexp_extract(target, pattern, k)
    return F.struct(F.when(hit, part(1)).otherwise(target).alias("path"), F.when(hit, part(2)).try_cast("int").alias("first"), F.when(hit, part(3)).try_cast("int").alias("last"))


def frontmatter(text: Column) -> Column:
    """head and body of a text that begins with a --- block; head is null for others."""
    # fixed value
    pattern = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    hit = text.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(text, pattern, 1)).alias("head"), F.when(hit, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def task_lines(body: Column) -> Column:
    """done, num, text of lines like '- [x] {#3} text', by num."""
    # fixed value
    pattern = r"^- \[([ xX])\]\s*\{#(\d+)\}\s*(.*)$"
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(pattern))
    return F.array_sort(F.transform(lines, lambda x: F.struct(part(x, 2).cast("int").alias("num"), (F.lower(part(x, 1)) == "x").alias("done"), part(x, 3).alias("text"))))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed_lines(body: Column) -> Column:
    return F.array_join(F.transform(F.split(body, "\n"), strip), "\n")


def _below(body: Column) -> Column:
    """heading and text of each part below a ## heading."""
    parts = F.split(F.concat(F.lit("\n"), body), r"\n##[ \t]+", -1)
    cut = lambda x: F.struct(strip(F.substring_index(x, "\n", 1)).alias("heading"), F.regexp_extract(x, r"(?s)^[^\n]*\n?(.*)$", 1).alias("text"))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), cut)


def section(body: Column, name: str) -> Column:
    """The text below headings of that name, without letter case and without what stands in brackets after it; empty if there is none."""
    mine = F.filter(_below(body), lambda x: F.lower(strip(F.substring_index(x.heading, "(", 1))) == name)
    return strip(F.array_join(F.transform(mine, lambda x: strip(x.text)), "\n"))


def first_heading(body: Column) -> Column:
    return F.get(F.filter(F.transform(_below(body), lambda x: x.heading), lambda x: x != ""), 0)


def first_title(body: Column) -> Column:
    """The text of the first line that begins with '# '."""
    return strip(F.substring(F.get(F.filter(F.split(body, "\n"), lambda x: x.startswith("# ")), 0), 3, 1 << 20))


def bullets(text: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(text, "\n"), F.ltrim), lambda x: x.startswith("- ")), lambda x: strip(F.substring(x, 3, 1 << 20)))


def marked(body: Column, word: str) -> Column:
    """What follows **word:** on the last line that begins so."""
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x.startswith(f"**{word}:**"))
    return F.when(F.size(lines) > 0, strip(F.substring(F.get(lines, F.size(lines) - 1), len(word) + 6, 1 << 20)))


def source_block(text: Column, first: Column, last: Column, most: int) -> Column:
    """Lines first to last (0-based) with right-justified numbers from 1, `most` lines at most."""
    lines = F.slice(F.split(text, "\n"), first + 1, F.least(last - first + 1, F.lit(most)))
    width = F.length((last + 1).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((first + i + 1).cast("string"), width, " "), F.lit("  "), x)), "\n")


def version_key(version: Column) -> Column:
    """The numbers of a version like v1.10.2, which compare as versions do; text after them does not count, and a version without numbers is empty."""
    head = F.regexp_extract(F.coalesce(version, F.lit("")), r"^v?(\d+(?:\.\d+)*)", 1)
    return F.transform(F.filter(F.split(head, r"\."), lambda x: x != ""), lambda x: x.cast("int"))


def normal_path(path: Column) -> Column:
    """A path in lower case with forward slashes, without . and with .. worked out; .. above the start stay."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda x: (x != "") & (x != "."))
    step = lambda kept, x: F.when((x == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != ".."), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def enforced(text: Column, needed: list[str], banned: list[str]) -> Column:
    """hits, breaks, enforced of a text: how many of the needed patterns it has, how many of the banned ones, and whether it has all of the one and none of the other."""
    count = lambda patterns: sum((F.when(text.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
    hits, breaks = count(needed), count(banned)
    return F.struct(hits.alias("hits"), breaks.alias("breaks"), ((hits == len(needed)) & (breaks == 0)).alias("enforced"))

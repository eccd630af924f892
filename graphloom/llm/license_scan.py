"""License scans by diagonal voting, with DataFrame functions only.

Every pair of neighbouring words of a text (a rolling 2-gram) is hashed and joined to the positions of the same pair in the
templates. A match at word p of the text and word q of a template votes for the diagonal p - q. A phrase stands
wherever one diagonal has all its pairs. For longer templates, diagonals at most `gap` apart are merged, so that inserted and
missing words do not split a passage, and the passage is verified by the share of the template's pairs that it covers.
Hash matches count only where the words are equal too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that the base counts, with their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Public license notices, with their labels.
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the text itself in the join, so that texts without any match stay; no word has a space.
_SELF = " "


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def template_rows(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, pairs, q, pair) of every pair; bounded by the templates given."""
    out = []
    for t, (base, label, text) in enumerate([(True, *p) for p in phrases] + [(False, *n) for n in notices]):
        w = text.split()
        if len(w) < 2:
            raise ValueError("a template has two words at least")
        out += [(t, label, base, len(w) - 1, q, f"{w[q]} {w[q + 1]}") for q in range(len(w) - 1)]
    return out


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    min_cover: float = 0.8,
    gap: int = 3,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts the places of all phrases; first_word and last_word are their least and greatest first words (null where
    there is none). labels also has those of notices of which a passage covers at least min_cover of the word pairs. score is
    the best cover of any phrase or accepted notice, else 0. A null text is an empty one; repeated rows give repeated results; a null
    id is an id. Other columns of docs are not read. The templates are broadcast: their size does not depend on docs.
    """
    spark = docs.sparkSession
    rows = [(-1, "", False, 0, 0, _SELF), *template_rows(phrases, notices)]
    templates = spark.createDataFrame(rows, "t int, label string, base boolean, pairs int, q int, pair string").withColumn("h", F.xxhash64("pair"))
    read = docs.select(F.col(doc_id).alias("doc"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), words(F.col(text)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = read.select("doc", "digest", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(_SELF)), pairs)).alias("p", "gram"))
    hit = grams.withColumn("h", F.xxhash64("gram")).join(F.broadcast(templates), "h").filter("gram = pair")
    # votes of a diagonal; p counts from 1 here, as the text itself stands at 0
    votes = hit.groupBy("doc", "digest", "n_words", "t", "label", "base", "pairs", (F.when(F.col("t") < 0, 0).otherwise(F.col("p") - 1 - F.col("q"))).alias("d")).agg(
        F.collect_set("q").alias("qs"), F.count("*").alias("c")
    )
    inside = Window.partitionBy("doc", "digest", "t").orderBy("d")
    new = F.when(F.col("base") | F.lag("d").over(inside).isNull() | (F.col("d") - F.lag("d").over(inside) > gap), 1).otherwise(0)
    merged = votes.withColumn("new", new).withColumn("passage", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passages = merged.groupBy("doc", "digest", "n_words", "t", "label", "base", "pairs", "passage").agg(
        F.min("d").cast("long").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("covered"), F.max(F.when(F.col("t") < 0, F.col("c"))).alias("copies")
    )
    cover = F.col("covered") / F.col("pairs")
    place = F.col("base") & (F.col("t") >= 0) & (F.col("covered") == F.col("pairs"))
    found = place | (~F.col("base") & (F.col("t") >= 0) & (cover >= min_cover))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = passages.groupBy("doc", "digest", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"),
        joined(place).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, cover)), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

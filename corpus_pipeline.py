"""Corpus pipeline over documents: rules, line dedup, near-duplicate removal, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontamination, jaccard, line_dedup, quality_rules
from graphloom.llm.queries import tokenizer
from graphloom.llm.shared import discard, reachable, settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does. Null and empty texts fail; repeated rows are judged one by one; columns beside COLUMNS go."""
    return quality_rules.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; n_chars counts what is left, which may be nothing. A null text becomes an empty one."""
    kept = line_dedup.drop_lines(docs.select(*COLUMNS), min_documents=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % join. Texts without words all stay; of repeated rows one stays."""
    return jaccard.keep_one(docs.select(*COLUMNS), k=5, similarity=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null texts and null ids stay."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and the digests of ids and decoded bytes; a null text has no ids."""
    path, pattern = tokenizer()
    return bpe.encode(docs.select(*COLUMNS), path, pattern, ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("byte-level bpe", tokens)]

#: Tokens, near-duplicate classes and template windows are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's documents are written before the next, and what only led to them is removed."""
    reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Files as sources: content hashes, node-link JSON, artifacts, Python symbols."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text


def scan(spark: SparkSession, root: str, suffixes: list[str], ignore: list[str]) -> DataFrame:
    """relpath, sha, content of files below root with one of the suffixes. A name in ignore leaves out what lies below a folder of that name, a path in it what lies below that path."""
    return _found(spark, root, suffixes, ignore).select("relpath", F.sha2("content", 256).alias("sha"), "content")


def listed(spark: SparkSession, root: str, suffixes: list[str], ignore: list[str]) -> DataFrame:
    """relpath, length, modified of the same files; their contents are not read."""
    return _found(spark, root, suffixes, ignore).select("relpath", "length", F.col("modificationTime").alias("modified"))


def _found(spark: SparkSession, root: str, suffixes: list[str], ignore: list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = found.withColumn("relpath", path)
    parents = F.slice(F.split("relpath", "/"), 1, F.size(F.split("relpath", "/")) - 1)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(F.col("relpath"), F.lit(s))
    below = F.lit(False)
    for p in ignore:
        if "/" in p.strip("/"):
            below = below | F.startswith(F.col("relpath"), F.lit(p.strip("/") + "/"))
    names = [p.strip("/") for p in ignore if "/" not in p.strip("/")]
    return rows.filter(ends & ~below & ~F.arrays_overlap(parents, F.array(*map(F.lit, names or [""]))))


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (relpath, sha) has not seen with this content."""
    return files.join(cache.select("relpath", "sha"), ["relpath", "sha"], "left_anti")


def python_symbols(files: DataFrame) -> DataFrame:
    """node_id, kind, label, first, last of modules, functions, classes and methods; a file that does not parse has its module only."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            rows = []
            for path, content in zip(frame["relpath"], frame["content"]):
                low = path.lower()
                rows.append((f"module:{low}", "module", path, 0, 0))
                try:
                    body = ast.parse(content).body
                except (SyntaxError, ValueError):
                    continue
                for item in body:
                    if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((f"sym:{low}#{item.name}", "function", item.name, item.lineno, item.end_lineno))
                    elif isinstance(item, ast.ClassDef):
                        rows.append((f"sym:{low}#{item.name}", "class", item.name, item.lineno, item.end_lineno))
                        rows += [(f"sym:{low}#{item.name}.{m.name}", "method", m.name, m.lineno, m.end_lineno) for m in item.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            yield pd.DataFrame(rows, columns=["node_id", "kind", "label", "first", "last"])

    return files.select("relpath", "content").mapInPandas(run, "node_id string, kind string, label string, first long, last long")


def plans(spark: SparkSession, path: str) -> DataFrame:
    """plan, num, done, text of the task lines of plan files."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("plan"), text.frontmatter(F.col("value")).alias("f"))
    return files.select("plan", F.explode(text.task_lines(F.col("f.body"))).alias("t")).select("plan", "t.*")


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("links").alias("e")).select("e.*")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes sorted by id and edges by (src, dst, relation), as JSON lines in two folders."""
    nodes.orderBy("node_id").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("src", "dst", "relation").write.mode("overwrite").json(f"{path}/links")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("type string, message struct<content:array<struct<type:string,name:string>>,usage:struct<input_tokens:long,output_tokens:long>>, duration_ms long, num_turns long").option("mode", "DROPMALFORMED").json(path)

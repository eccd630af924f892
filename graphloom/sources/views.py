"""Stored views of a repository's graph, in committed versions.

If the files' paths, sizes and times and the recipe are those of the last version, it is loaded and no file is opened; else only files whose contents
changed are read anew. Empty files are no files here, as Spark's readers pass them over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import drift
from graphloom.sources import artifacts, files, python_code
from graphloom.versions import Versions

PARTS = ["nodes", "edges", "dangling", "code", "problems"]
#: Changes with the columns of a stored view; views of another schema are built anew.
SCHEMA = "view-1"
SKIP = [".git", ".venv", "node_modules", "__pycache__"]


@dataclass(frozen=True)
class View:
    """A graph, the rows of its code and the problems of its artifacts; version counts up, built says whether this call made it."""

    graph: Graph
    code: DataFrame
    problems: DataFrame
    version: int
    built: bool


def fingerprint(spark: SparkSession, root: str, ignore: list[str]) -> str:
    """Of the paths, sizes and times of a repository's files."""
    rows = files.listed(spark, root, [".py", ".md"], ignore)
    found = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("relpath", "length", "modified")).alias("x"), F.sum("length").alias("size")).first()
    return f"{found.n}:{found.size}:{found.x}"


def recipe() -> str:
    return f"{SCHEMA} {python_code.RECIPE}"


def load_or_build(spark: SparkSession, root: str, path: str, ignore: list[str] | None = None) -> View:
    """The view of a repository below path: the stored one if nothing changed, else a new version of it, in which links to renamed symbols go to their new names."""
    store, skip = Versions(spark, path), ignore or SKIP
    made_from = {"recipe": recipe(), "files": fingerprint(spark, root, skip), "ignore": sorted(skip)}
    head = store.head()
    if head and head[1] == made_from:
        return _view(store, head[0], False)
    kept = store.read(head[0], "code") if head and head[1].get("recipe") == made_from["recipe"] else None
    graph, code, problems = artifacts.build(spark, root, kept, skip)
    graph = drift.reanchor(graph)
    folder = store.write(dict(zip(PARTS, (graph.nodes, graph.edges, graph.dangling, code, problems))), made_from)
    return _view(store, folder, True)


def _view(store: Versions, folder: str, built: bool) -> View:
    nodes, edges, dangling, code, problems = (store.read(folder, name) for name in PARTS)
    return View(Graph(nodes, edges, dangling), code, problems, int(folder.split("-")[1]), built)

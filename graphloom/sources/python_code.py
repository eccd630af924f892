"""The structure of Python files: symbols with content hashes, and their contains, calls, imports and inherits edges.

A file is read on its own by a Python worker, which leaves nodes, edges inside the file and requests to other files. Imports and base classes are then
resolved by joins over all files. The rows of a file depend on its path and content only, so they are kept for files that did not change.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.tables import materialize

#: Rows of a file: what is node, edge, import (a = file, b = module as written) or base (a = class, b = module, empty for the own file, c = name).
ROWS = "relpath string, sha string, what string, a string, b string, c string, kind string, label string, first long, last long, hash string, recipe string"
#: Names how hashes and rows are made: rows of another recipe are void, and hashes of two recipes are not comparable.
RECIPE = "py-tokens-1"
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ROWS.split(", ")])
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class _Bare(ast.NodeTransformer):
    """A tree without docstrings, in which the symbols of `inside` are only their names."""

    def __init__(self, inside: dict[ast.AST, str]):
        self.inside = inside

    def visit(self, node: ast.AST) -> ast.AST:
        if node in self.inside:
            return ast.Expr(ast.Name(f"<def:{self.inside[node]}>"))
        if isinstance(node, (*_DEFS, ast.Module)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:]
        return self.generic_visit(node)


def _tokens(node: object) -> Iterator[str]:
    """What a tree says, in order. Fields that are empty do not count, so a syntax tree of another version that has more of them says the same."""
    if isinstance(node, ast.AST):
        yield f"({type(node).__name__}"
        for name, value in ast.iter_fields(node):
            if value is not None and value != [] and name not in ("ctx", "type_comment", "kind"):
                yield name
                yield from _tokens(value)
        yield ")"
    elif isinstance(node, list):
        for part in node:
            yield from _tokens(part)
    else:
        yield f"{type(node).__name__}:{node!r}"


def content_hash(tree: ast.AST, inside: dict[ast.AST, str]) -> str:
    """Hash of what a symbol does: comments, layout, quotes, docstrings and its own name do not count, symbols inside it only by name. The tree is used up."""
    bare = _Bare(inside).generic_visit(tree) if not isinstance(tree, ast.Module) else _Bare(inside).visit(tree)
    if isinstance(bare, _DEFS):
        bare.name = ""
        if bare.body and isinstance(bare.body[0], ast.Expr) and isinstance(bare.body[0].value, ast.Constant) and isinstance(bare.body[0].value.value, str):
            bare.body = bare.body[1:]
    return hashlib.sha256("\0".join(_tokens(bare)).encode("utf-8", "surrogatepass")).hexdigest()


def _calls(node: ast.AST, inside: set[ast.AST]) -> Iterator[ast.Call]:
    """The calls of a symbol itself."""
    for child in ast.iter_child_nodes(node):
        if child not in inside:
            if isinstance(child, ast.Call):
                yield child
            yield from _calls(child, inside)


def _modules(body: list[ast.stmt]) -> tuple[set[str], dict[str, tuple[str, str]]]:
    """Modules that a file imports at its top, with leading dots as written, and where names come from: name to (module, name there)."""
    modules, names = set(), {}
    for s in body:
        if isinstance(s, ast.Import):
            modules |= {a.name for a in s.names}
        elif isinstance(s, ast.ImportFrom):
            dots = "." * s.level
            if s.module:
                modules.add(dots + s.module)
                names |= {a.asname or a.name: (dots + s.module, a.name) for a in s.names}
            else:
                modules |= {dots + a.name for a in s.names}
    return modules, names


def rows_of(relpath: str, sha: str, content: bytes) -> list[tuple]:
    """ROWS of one file; one that does not parse is a file and a module without symbols, with the hash of its bytes."""
    low = relpath.casefold()
    file_id, module_id = f"file:{low}", f"module:{low}"
    out: list[tuple] = []
    row = lambda what, a, b=None, c=None, kind=None, label=None, first=None, last=None, hash_=None: out.append((relpath, sha, what, a, b, c, kind, label, first, last, hash_))
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        for i, kind in ((module_id, "module"), (file_id, "file")):
            row("node", i, kind=kind, label=relpath, hash_=hashlib.sha256(content).hexdigest())
        row("edge", file_id, module_id, "contains")
        return out
    symbols = []  # id, kind, name, node, container, class
    for s in tree.body:
        if isinstance(s, _DEFS):
            at = f"sym:{low}#{s.name}"
            symbols.append((at, "class" if isinstance(s, ast.ClassDef) else "function", s.name, s, module_id, None))
            if isinstance(s, ast.ClassDef):
                symbols += [(f"{at}.{m.name}", "method", f"{s.name}.{m.name}", m, at, s.name) for m in s.body if isinstance(m, _DEFS[:2])]
    known = {i for i, *_ in symbols}
    inner = {node for *_, node, _, _ in symbols}
    found = set()
    for at, _, _, node, _, owner in symbols:
        for call in _calls(node, inner):
            f, target = call.func, None
            if isinstance(f, ast.Name):
                target = f"sym:{low}#{f.id}"
            elif owner and isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self":
                target = f"sym:{low}#{owner}.{f.attr}"
            if target in known and target != at:
                found.add((at, target))
    modules, names = _modules(tree.body)
    for at, kind, _, node, _, _ in symbols:
        if kind == "class":
            for base in node.bases:
                if isinstance(base, ast.Name):
                    module, name = names.get(base.id, ("", base.id))
                    row("base", at, module, name)
    for m in sorted(modules):
        row("import", file_id, m)
    row("edge", file_id, module_id, "contains")
    for at, _, _, _, container, _ in symbols:
        row("edge", container, at, "contains")
    for a, b in sorted(found):
        row("edge", a, b, "calls")
    lines = [(node.lineno - 1, node.end_lineno - 1) for *_, node, _, _ in symbols]
    # hashing uses trees up: the module has one of its own, methods go before their class
    again = ast.parse(content)
    whole = content_hash(again, {s: s.name for s in again.body if isinstance(s, _DEFS)})
    own = {}
    for at, kind, _, node, _, _ in symbols:
        if kind == "class":
            methods = {m: m.name for m in node.body if isinstance(m, _DEFS[:2])}
            own |= {f"{at}.{name}": content_hash(m, {}) for m, name in reversed(methods.items())}
            own.setdefault(at, content_hash(node, methods))
        elif kind == "function":
            own.setdefault(at, content_hash(node, {}))
    for i, kind in ((module_id, "module"), (file_id, "file")):
        row("node", i, kind=kind, label=relpath, first=0, last=content.count(b"\n"), hash_=whole)
    seen = set()
    for (at, kind, label, *_), (first, last) in zip(symbols, lines):
        if at not in seen:  # of two definitions of a name the first
            seen.add(at)
            row("node", at, kind=kind, label=label, first=first, last=last, hash_=own[at])
    return out


def unread(files: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The files (relpath, sha, content) that kept has no rows of by this recipe."""
    return files if kept is None else files.join(kept.filter(F.col("recipe") == RECIPE).select("relpath", "sha").distinct(), ["relpath", "sha"], "left_anti")


def project(files: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """ROWS of all files (relpath, sha, content), written. Rows of kept whose path, content and recipe are the same are taken over and only the other files are read."""
    new, recipe = unread(files, kept), RECIPE

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, sha, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                columns = zip(*(row + (recipe,) for row in rows_of(path, sha, content or b"")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA)], schema=_SCHEMA)

    read = new.select("relpath", "sha", "content").mapInArrow(run, ROWS)
    if kept is not None:
        read = read.unionByName(kept.filter(F.col("recipe") == recipe).join(files.select("relpath", "sha"), ["relpath", "sha"], "left_semi"))
    return materialize(read)


def _candidates(relpath: F.Column) -> F.Column:
    """The dotted module names of a file: its path, also without a leading src; a package for its __init__."""
    stem = F.regexp_replace(relpath, r"\.py$", "")
    parts = F.split(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/")
    parts = F.filter(parts, lambda x: x != "")
    short = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.filter(F.transform(F.array(parts, F.coalesce(short, parts)), lambda p: F.array_join(p, ".")), lambda x: x != "")


def _resolved(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (relpath, b: module as written, and others) with the file id that the module is, where there is one: the first by name of several."""
    modules = files.select(F.concat(F.lit("file:"), F.lower("relpath")).alias("target"), F.explode(_candidates(F.col("relpath"))).alias("module"))
    first = modules.groupBy(F.lower("module").alias("module")).agg(F.min("target").alias("target"))
    dots = F.length(F.regexp_extract("b", r"^(\.*)", 1))
    tail = F.regexp_extract("b", r"^\.*(.*)$", 1)
    # a relative module hangs on the importer's own module path, less one part for each dot; __init__ counts as a part
    stem = F.regexp_replace("relpath", r"\.py$", "")
    paths = F.array(F.split(stem, "/"), F.split(F.regexp_replace(stem, "^src/", ""), "/"))
    package = F.transform(paths, lambda p: F.when(F.element_at(p, -1) == "__init__", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    up = F.transform(F.filter(package, lambda p: F.size(p) >= dots), lambda p: F.concat_ws(".", F.array_join(F.slice(p, 1, F.size(p) - dots), "."), F.nullif(tail, F.lit(""))))
    wanted = F.when(dots > 0, F.transform(up, lambda x: F.regexp_replace(x, r"^\.+", ""))).otherwise(F.array("b"))
    keyed = requests.withColumn("_n", F.monotonically_increasing_id()).withColumn("module", F.explode_outer(F.array_distinct(wanted)))
    hit = keyed.withColumn("low", F.lower("module")).join(first.withColumnRenamed("module", "low"), "low", "left")
    best = hit.groupBy("_n", *requests.columns).agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("module"))).alias("target"))
    return best.drop("_n")


def structure(rows: DataFrame) -> Graph:
    """Nodes and edges of all files from their ROWS. Imports and base classes that no file defines have no edge."""
    none = F.lit(None).cast("string")
    nodes = rows.filter("what = 'node'").select(F.col("a").alias("node_id"), F.lit("structure").alias("family"), "kind", "label", none.alias("status"), none.alias("state"), none.alias("maturity"), none.alias("grounding"), none.alias("attestation"), F.col("hash").alias("content_hash"), F.col("relpath").alias("source_file"), "first", "last")
    files = rows.select("relpath").distinct()
    inside = rows.filter("what = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("relation"))
    imports = _resolved(rows.filter("what = 'import'").select("relpath", "a", "b"), files).filter("target is not null and target <> a").select(F.col("a").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("relation"))
    bases = rows.filter("what = 'base'").select("relpath", "a", "b", "c")
    own = bases.filter("b = ''").withColumn("target", F.concat(F.lit("file:"), F.lower("relpath")))
    named = own.unionByName(_resolved(bases.filter("b <> ''"), files)).filter("target is not null")
    parent = F.concat(F.lit("sym:"), F.substring("target", 6, 100_000), F.lit("#"), F.col("c"))
    inherits = named.select(F.col("a").alias("src"), parent.alias("dst")).filter("src <> dst").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("inherits").alias("relation"))
    edges = inside.unionByName(imports).unionByName(inherits).distinct()
    full = edges.select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), none.alias("anchor"), F.lit(False).alias("pending"))
    return Graph(nodes, full, rows.sparkSession.createDataFrame([], "src string, relation string, target string, anchor string"))


def govern(code: Graph, nodes: DataFrame, links: DataFrame) -> Graph:
    """A code graph with other nodes and their links (src, relation, target, anchor, and pending): a link whose target is no node of either dangles."""
    every = code.nodes.unionByName(nodes, allowMissingColumns=True)
    ids = every.select(F.col("node_id").alias("target"))
    found = links.join(ids, "target", "left_semi").select("src", F.col("target").alias("dst"), "relation", F.lit("EXTRACTED").alias("confidence"), "anchor", (F.col("pending") if "pending" in links.columns else F.lit(False)).alias("pending"))
    lost = links.join(ids, "target", "left_anti").select("src", "relation", "target", "anchor")
    return Graph(every, code.edges.unionByName(found), code.dangling.unionByName(lost))

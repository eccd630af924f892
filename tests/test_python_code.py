"""Python files to a graph: edges, hashes, reuse, and drift after edits, renames and deletions."""

from pyspark.sql import functions as F

from graphloom.operators import drift
from graphloom.sources import files, python_code

BASE = {
    "src/pkg/__init__.py": "",
    "src/pkg/base.py": "class Base:\n    def run(self):\n        return 1\n",
    "src/pkg/auth.py": '"""Auth."""\nfrom .base import Base as B\nfrom . import util\nimport pkg.base, os\n\ndef check(x):\n    "doc"\n    return x == "a"\n\n\nclass Login(B):\n    limit = 3\n\n    def run(self):\n        check(1)\n        self.stop()\n        print(2)\n\n    def stop(self):\n        return check(2)\n',
    "src/pkg/util.py": "def helper():\n    def inner():\n        return helper()\n    return inner\n",
    "broken.py": "def (:\n",
    "notes.txt": "def no(): pass\n",
}


def scan(spark, root, tree):
    for path, body in tree.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    return files.scan(spark, str(root), [".py"], [])


def hashes(graph):
    return {r.node_id: r.content_hash for r in graph.nodes.collect()}


def test_structure(spark, tmp_path):
    graph = python_code.structure(python_code.project(scan(spark, tmp_path, BASE)))
    nodes = {r.node_id: r.kind for r in graph.nodes.collect()}
    assert nodes["sym:src/pkg/auth.py#Login"] == "class" and nodes["sym:src/pkg/auth.py#Login.run"] == "method" and nodes["module:broken.py"] == "module"
    assert not any("inner" in n or "notes" in n for n in nodes)
    edges = {(r.src, r.dst, r.relation) for r in graph.edges.collect()}
    auth = "sym:src/pkg/auth.py#"
    assert {e for e in edges if e[2] == "calls"} == {(auth + "Login.run", auth + "check", "calls"), (auth + "Login.run", auth + "Login.stop", "calls"), (auth + "Login.stop", auth + "check", "calls")}
    assert {e[1] for e in edges if e[2] == "imports"} == {"file:src/pkg/base.py", "file:src/pkg/util.py"}
    assert {e[:2] for e in edges if e[2] == "inherits"} == {(auth + "Login", "sym:src/pkg/base.py#Base")}
    assert ("file:broken.py", "module:broken.py", "contains") in edges and (auth + "Login", auth + "Login.stop", "contains") in edges


def test_hashes_look_at_what_code_does(spark, tmp_path):
    before = hashes(python_code.structure(python_code.project(scan(spark, tmp_path / "a", BASE))))
    same = BASE | {"src/pkg/auth.py": "# new comment\n" + BASE["src/pkg/auth.py"].replace('"a"', "'a'").replace('    "doc"\n', "").replace("def check(x):", "def check( x ):")}
    assert hashes(python_code.structure(python_code.project(scan(spark, tmp_path / "b", same)))) == before
    edit = BASE | {"src/pkg/auth.py": BASE["src/pkg/auth.py"].replace("print(2)", "print(3)")}
    after = hashes(python_code.structure(python_code.project(scan(spark, tmp_path / "c", edit))))
    assert {n for n in before if before[n] != after[n]} == {"sym:src/pkg/auth.py#Login.run"}


def test_unchanged_files_are_taken_over(spark, tmp_path):
    first = python_code.project(scan(spark, tmp_path, BASE))
    marked = first.withColumn("label", F.when(F.col("what") == "node", F.lit("kept")).otherwise(F.col("label")))
    (tmp_path / "src/pkg/util.py").unlink()
    again = python_code.project(scan(spark, tmp_path, {"src/pkg/base.py": "class Base:\n    pass\n"}), marked)
    labels = {r.a: r.label for r in again.filter("what = 'node'").collect()}
    assert labels["sym:src/pkg/auth.py#check"] == "kept" and labels["sym:src/pkg/base.py#Base"] == "Base"
    assert not any("util.py" in n or n.endswith("Base.run") for n in labels)


def test_drift_of_real_files(spark, tmp_path):
    """An edited symbol drifts softly, a renamed one is found by its content, a deleted one is gone."""
    auth = "sym:src/pkg/auth.py#"
    now = hashes(python_code.structure(python_code.project(scan(spark, tmp_path, BASE))))
    tasks = spark.createDataFrame([("task:p/1", "plan", "task", "todo")], "node_id string, family string, kind string, state string")
    targets = [auth + "Login.run", auth + "check", "sym:src/pkg/util.py#helper", "sym:src/pkg/base.py#Base"]
    links = spark.createDataFrame([("task:p/1", "implements", t, now[t]) for t in targets], "src string, relation string, target string, anchor string")
    moved = BASE["src/pkg/auth.py"].replace("print(2)", "print(3)").replace("check", "verify")
    tree = scan(spark, tmp_path, {"src/pkg/auth.py": moved, "src/pkg/util.py": ""})
    graph = python_code.govern(python_code.structure(python_code.project(tree)), tasks, links)
    assert {(r.kind, r.dst) for r in drift.items(graph).collect()} == {("soft", auth + "Login.run"), ("renamed", auth + "verify"), ("hard", "sym:src/pkg/util.py#helper")}

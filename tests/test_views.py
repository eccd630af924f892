"""Stored views: unchanged inputs, changed files, renames, failed writes, other recipes."""

import pytest

from graphloom.operators import drift
from graphloom.sources import artifacts, files, python_code, views
from graphloom.versions import Versions

CODE = {"src/a.py": "def login(x):\n    return x\n", "src/b.py": "def other():\n    return 2\n"}


def _write(root, tree):
    for path, body in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)


def _anchor(graph, node_id):
    return {r.node_id: r.content_hash for r in graph.nodes.collect()}[node_id]


def test_a_view_over_its_life(spark, tmp_path, monkeypatch):
    root, path = tmp_path / "repo", str(tmp_path / "views")
    _write(root, CODE)
    first = views.load_or_build(spark, str(root), path)
    assert first.built and first.version == 1 and first.graph.edges.count() > 0
    login = _anchor(first.graph, "sym:src/a.py#login")

    # nothing changed: nothing is extracted
    with monkeypatch.context() as m:
        m.setattr(artifacts, "build", lambda *a, **k: pytest.fail("extraction of unchanged files"))
        same = views.load_or_build(spark, str(root), path)
    assert not same.built and same.version == 1
    assert sorted(map(str, same.graph.nodes.collect())) == sorted(map(str, first.graph.nodes.collect()))

    # a decision on login; then login is renamed: the link goes along, and only the changed file is read
    _write(root, {"notes/memory/001-why.md": f"---\nconcerns:\n  - sym: sym:src/a.py#login\n    anchor: {login}\n---\n## Why login\n", "src/a.py": "def sign_in(x):\n    return x\n"})
    scanned = files.scan(spark, str(root), [".py"], views.SKIP)
    assert [r.relpath for r in python_code.unread(scanned, same.code).collect()] == ["src/a.py"]
    second = views.load_or_build(spark, str(root), path)
    assert second.version == 2 and {(r.src, r.dst) for r in second.graph.edges.filter("relation = 'concerns'").collect()} == {("mem:001", "sym:src/a.py#sign_in")}
    assert second.graph.dangling.count() == 0 and drift.items(second.graph).count() == 0

    # a write that fails leaves the view that was there
    _write(root, {"src/c.py": "x = 1\n"})
    with monkeypatch.context() as m:
        m.setattr(drift, "reanchor", lambda g: type(g)(g.nodes, g.edges, g.dangling.selectExpr("raise_error('broken') as src", "relation", "target", "anchor")))
        with pytest.raises(Exception, match="broken"):
            views.load_or_build(spark, str(root), path)
    store = Versions(spark, path)
    assert store.head()[0].startswith("v-2-") and len(store._folders()) == 3
    assert second.graph.nodes.count() > 0
    third = views.load_or_build(spark, str(root), path)
    assert third.version == 4 and "module:src/c.py" in {r.node_id for r in third.graph.nodes.collect()}
    # what was left over and all but the version before are gone
    assert sorted(store._folders().values()) == [2, 4]

    # another recipe: stored rows are void
    monkeypatch.setattr(python_code, "RECIPE", "py-other")
    assert python_code.unread(files.scan(spark, str(root), [".py"], views.SKIP), third.code).count() == 3
    fourth = views.load_or_build(spark, str(root), path)
    assert fourth.built and {r.recipe for r in fourth.code.select("recipe").distinct().collect()} == {"py-other"}


def test_hashes_do_not_depend_on_the_tree_of_an_interpreter(spark):
    """Fields that are empty do not count, whether a version of the tree has them or not."""
    import ast

    tree = ast.parse("def f(a, *, b=1):\n    'doc'\n    return [a, b'x', 1.5, ..., None]\n").body[0]
    was = python_code.content_hash(ast.parse("def f(a, *, b=1):\n    return [a, b'x', 1.5, ..., None]\n").body[0], {})
    tree._fields = (*type(tree)._fields, "added_later")
    tree.added_later = []
    assert python_code.content_hash(tree, {}) == was
    assert python_code.content_hash(ast.parse("def f(a, *, b=2):\n    return [a, b'x', 1.5, ..., None]\n").body[0], {}) != was


def test_ignored_names_and_paths(spark, tmp_path):
    _write(tmp_path, dict.fromkeys(["a/x.py", "b/a/y.py", "c/d/z.py", "c/e/w.py"], "x = 1\n"))
    found = lambda ignore: {r.relpath for r in files.listed(spark, str(tmp_path), [".py"], ignore).collect()}
    assert found(["a"]) == {"c/d/z.py", "c/e/w.py"} and found(["c/d"]) == {"a/x.py", "b/a/y.py", "c/e/w.py"} and len(found([])) == 4

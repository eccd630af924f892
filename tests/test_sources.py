from graphloom.sources import files


def test_python_files(spark, tmp_path):
    (tmp_path / "auth").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "auth/session.py").write_text("def refresh(token):\n    return token\n\nclass A:\n    def m(self):\n        pass\n")
    (tmp_path / "bad.py").write_text("def (\n")
    (tmp_path / "skip/x.py").write_text("x = 1\n")
    (tmp_path / "note.txt").write_text("no")
    found = files.scan(spark, str(tmp_path), [".py"], ["skip"])
    assert {r.relpath for r in found.collect()} == {"auth/session.py", "bad.py"}
    ids = {r.node_id for r in files.python_symbols(found).collect()}
    assert ids == {"module:auth/session.py", "sym:auth/session.py#refresh", "sym:auth/session.py#A", "sym:auth/session.py#A.m", "module:bad.py"}
    cache = found.filter("relpath = 'bad.py'").select("relpath", "sha")
    assert [r.relpath for r in files.changed(found, cache).collect()] == ["auth/session.py"]


def test_plans(spark, tmp_path):
    (tmp_path / "auth.md").write_text("---\nphase: active\n---\n- [x] {#2} two\n- [ ] {#1} one\n")
    got = files.plans(spark, f"{tmp_path}/*.md").orderBy("num").collect()
    assert [(r.plan, r.num, r.done, r.text) for r in got] == [("auth", 1, False, "one"), ("auth", 2, True, "two")]

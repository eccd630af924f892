"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    expected = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in frame.collect()) == expected


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_optional_folders(tmp_path, pipeline):
    """The entry point works when the training-data folders are gone, whether or not the pipeline's file is."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_a_broken_import_is_no_missing_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import graphloom.nothing_of_this_name\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True)
    assert done.returncode != 0

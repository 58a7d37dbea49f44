"""All queries of the library against DuckDB, and the shape of the repository."""

import ast
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

from conftest import ROOT, SMALL
from tallyloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SMALL)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert oracle.compare(df, oracle.connect(SMALL), sql) is None
    else:  # held against plain models in test_sequential.py and test_operators.py
        assert df.count() > 0


def test_nothing_imports_the_training_data_subpackage():
    for path in Path(ROOT, "tallyloom").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in n for n in names), path


def test_entry_works_without_it(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "tallyloom", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tallyloom").mkdir()
    for p in (ROOT / "tallyloom").iterdir():
        if p.name != "llm":
            (tmp_path / "tallyloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reconcile' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

"""The driver's entry points, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from spanforge.plans.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.outcome for r in rows} == {"EXACT", "COVERED", "OVERBROAD", "PARTIAL", "MISS"}


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert e.llm is None and 'span_outcome' in q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})

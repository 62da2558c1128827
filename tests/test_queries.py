"""Every query that SQL can express gives what DuckDB gives; the others run with a stable schema."""

from __future__ import annotations

import pytest

from tessera import catalog
from tests.conftest import DATA

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, same_as_sql):
    same_as_sql(catalog.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_twice_alike(name, spark):
    query = catalog.queries()[name]
    first, second = query(spark, DATA), query(spark, DATA)
    assert first.schema == second.schema
    assert sorted(map(repr, first.collect())) == sorted(map(repr, second.collect()))


def test_library_does_not_need_the_pipeline_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tessera"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("tessera.llm") for n in names), path


def test_entry_without_the_pipeline_operators(tmp_path):
    """With both llm folders gone, and with or without corpus_pipeline.py, the other queries are registered and run."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    script = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = e.queries()
assert len(names) > 100 and "pipeline" not in names and not any(n.startswith("op1") for n in names), names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() >= 0 and names["funnel_counts"](spark, {DATA!r}).count() > 0
"""
    for rest in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(rest)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *rest))
        run = subprocess.run([sys.executable, "-c", script], cwd=copy, env={**__import__("os").environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]

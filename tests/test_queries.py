"""Every registered query of the library runs; those with an oracle give DuckDB's rows."""

from __future__ import annotations

import os

import pytest

from boxwood import registry

from compare import duck_rows, spark_rows

registry.load()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, small))
    assert columns and len(set(columns)) == len(columns)
    if name in registry.ORACLES:
        assert (columns, rows) == duck_rows(duck, registry.ORACLES[name])


def test_every_table_is_known(spark, small):
    for t in registry.TABLES:
        assert registry.table(spark, small, t).columns


def test_names_are_unique():
    with pytest.raises(ValueError):
        registry.query("sql_inner_join")(lambda spark, d: None)


def test_llm_isnt_needed(tmp_path):
    """The entry imports, and its other queries are there, without the folders that may go."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "boxwood", tmp_path / "boxwood", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'holdout_sample' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    # The other tests import, and a module of them passes.
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, check=True, timeout=300, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_subgraphs.py", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, check=True, timeout=300, stdout=subprocess.DEVNULL)


def test_a_broken_import_is_no_missing_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "boxwood", tmp_path / "boxwood", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "boxwood/llm").mkdir()
    (tmp_path / "boxwood/llm/__init__.py").write_text("import nowhere_to_be_found")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120, capture_output=True, text=True)
    assert found.returncode and "nowhere_to_be_found" in found.stderr

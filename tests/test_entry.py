"""The driver's contract, with the corpus operators or without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "/root/testdata/sf0.001"


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40 and "bgp_multi_hop" in q


def test_without_the_corpus_operators(tmp_path):
    for name in ("quadrille", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quadrille" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bgp_multi_hop' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "quadrille.llm" not in f.read_text()


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no tables here")
def test_entry_and_sql(spark):
    import duckdb

    assert entry.entry(spark).count() > 0
    c = duckdb.connect()
    for t in os.listdir(TABLES):
        at = f"{TABLES}/{t}" + ("/*.parquet" if os.path.isdir(f"{TABLES}/{t}") else "")
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{at}'")
    from quadrille.plans import registry

    sql = registry.oracle_sql()
    for name in ("bgp_multi_hop", "optional_left_join", "exists", "group_sum_avg_having", "search_scan", "update_delete_insert", "numeric_functions", "path_transitive"):
        got = registry.queries()[name](spark, TABLES).toPandas()
        want = c.execute(sql[name]).fetchdf()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        rows = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))  # noqa: E731, B023
        assert rows(got) == rows(want), name

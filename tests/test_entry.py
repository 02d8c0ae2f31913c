from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_llm(tmp_path):
    """What the library is without the subpackage and the pipeline."""
    import shutil

    shutil.copytree(ROOT / "rollcall", tmp_path / "rollcall", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_queries_match_sql(spark):
    from rollcall import plans

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    sql = plans.oracle_sql()
    for name, query in plans.queries().items():
        got = query(spark, str(DATA)).collect()
        if name not in sql:
            assert got, name
            continue
        want = con.sql(sql[name])
        columns = sorted(want.columns)
        show = lambda x: round(x, 6) if isinstance(x, float) else x
        a = sorted(([show(r[c]) for c in columns] for r in got), key=repr)
        at = [want.columns.index(c) for c in columns]
        b = sorted(([show(r[i]) for i in at] for r in want.fetchall()), key=repr)
        assert a == b, name

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
QUICK = ["agg_basic", "rollup", "join_full", "distinct_on", "means_filter", "means_case_guard", "extract_struct", "semantic_key_column", "lag_lead"]


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


@pytest.mark.parametrize("name", QUICK)
def test_against_the_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    df = entry.queries()[name](spark, D)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(norm(v) for v in row) for row in r.fetchall()), key=str)
    got = sorted((tuple(norm(row[n]) for n in names) for row in df.collect()), key=str)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


def test_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_inner' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})

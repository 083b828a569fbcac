"""Every registered log query against its SQL in DuckDB, at the smallest scale; and what is left without sawmill.llm."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from sawmill import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        assert got
        return
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_an_export_of_a_part_says_how_many_rows_there_are(spark, monkeypatch):
    monkeypatch.setattr(queries.files, "EXPORT_MOST", 100)
    got = queries.QUERIES["s5_export_all"](spark, DATA).select("seq", "n").collect()
    assert sorted(map(tuple, got)) == [(seq, 1000) for seq in range(100)]


def test_lines_are_made_by_several_tasks_whatever_the_file(spark):
    assert queries.json_lines(queries.events(spark, DATA)).rdd.getNumPartitions() > 1


def test_stands_without_the_training_data_operators(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{repo}/sawmill", tmp_path / "sawmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a1_histogram' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    os.makedirs(tmp_path / "tests")
    for name in ("conftest.py", "test_logs.py"):
        shutil.copy(f"{repo}/tests/{name}", tmp_path / "tests")
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests", "-k", "predicates or levels or facets or resume"], check=True, cwd=tmp_path)

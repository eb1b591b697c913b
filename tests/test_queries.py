"""Every query that has an SQL twin gives the same rows as DuckDB over the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

spec = importlib.util.spec_from_file_location("check_oracle", Path(__file__).parent.parent / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    cursor = db.execute(SQL[name])
    want = check.rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0

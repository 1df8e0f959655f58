"""Every registered query against its DuckDB statement, and what its plan must not contain."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
SPARSE = {"adjacency_join"}  # too few detections at this scale to touch each other
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] or name in SPARSE, "no rows"
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        names = [d[0] for d in answer.description]
        assert got == rows(names, answer.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0

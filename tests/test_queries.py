"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from repoquarry.workload import load
from repoquarry.workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    return db


def normal(records):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted("|".join(value(v) for v in r) for r in records)


# Neither rows handled in Python nor every row paired with every other.
BANNED = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_query_equals_twin(spark, connection, name):
    queries, twins = load()
    df = queries[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]
    result = connection.execute(twins[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.select(*columns).collect()) == normal(result.fetchall())


def test_every_query_has_a_twin():
    queries, twins = load()
    assert set(queries) == set(twins)

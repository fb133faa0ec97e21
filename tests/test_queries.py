"""All registered queries at the smallest scale against their SQL, and no plan with a product of two inputs."""

import duckdb
import pytest

from tools.check import TABLES, rows
from workloads import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_oracle_belongs_to_a_query():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, cursor.fetchall())


def test_flagship(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())

"""Every query against the same question in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in sorted(os.listdir(SF_DIR)):
        name = path.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    from lidarlake.plans import catalogue

    assert set(catalogue.queries()) <= set(ORACLE)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_equals_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLE[name])
    names = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(names)
    order = sorted(names)
    mine = [tuple(row[c] for c in order) for row in result.collect()]
    at = [names.index(c) for c in order]
    theirs = [tuple(row[i] for i in at) for row in expected.fetchall()]
    assert len(mine) == len(theirs)
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0

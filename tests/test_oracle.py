"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, database

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, rows, verdict = compare(spark, con, FOLDER, QUERIES[name], ORACLE.get(name))
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0 or verdict == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "fair_value" in df.columns

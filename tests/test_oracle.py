"""Every named query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
import oracle
from check import compare, oracle_connection
from lapsewise.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.REGISTRY))
def test_query(spark, connection, name):
    ok, n, note = compare(spark, connection, SF_DIR, name)
    assert ok, note
    assert n > 0


def test_every_statement_has_a_query():
    assert set(oracle.statements()) == set(catalog.REGISTRY)
    assert set(catalog.REGISTRY) <= set(spark_entry.queries())
    assert set(oracle.statements()) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 181
    assert df.columns[0] == "rank"

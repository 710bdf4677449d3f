"""Every registered query against DuckDB on the smallest data set."""

import pytest

import __spark_entry__
from checks import oracle
from checks.compare import connect, differences
from checks.queries import registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(registered()) == set(oracle.statements())
    assert set(registered()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, database, name):
    df = registered()[name](spark, SF_DIR)
    collected = [tuple(r) for r in df.collect()]
    assert differences(df.columns, collected, database, oracle.statements()[name]) == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, connection

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in CHECKS:
        assert compare(df, CHECKS[name], con) is None
    else:
        df.collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0

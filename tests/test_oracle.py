"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import pytest
from conftest import SF
from oracle_compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want, problems = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert not problems, problems
    assert want is None or got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

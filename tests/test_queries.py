"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, duck, view

import __spark_entry__ as entry
from recapspark.plans import oracle, registry

QUERIES, SQL = dict(registry.QUERIES), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"fit_map"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    if name in SQL:
        assert compare(got, view(con, SQL[name])) is None
    else:
        assert got.num_rows > 0


def test_registered(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

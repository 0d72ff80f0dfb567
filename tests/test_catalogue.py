"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], SQLS[name], sf).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "val", "test"}

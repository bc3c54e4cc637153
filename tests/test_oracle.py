"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registry
from oracle import compare, connect
from sluicework.queries import audits, scalar, tabular

QUERIES = {**tabular.QUERIES, **scalar.QUERIES, **audits.QUERIES}
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) and set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    assert registry.entry(spark).count() > 0

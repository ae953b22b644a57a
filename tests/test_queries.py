"""Every registered query against its SQL on the small tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    assert compare(spark, con, sf_dir, queries()[name], oracle_sql().get(name)) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0

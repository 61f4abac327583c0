"""Every registered query against its checking SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) in (None, "both empty")


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0

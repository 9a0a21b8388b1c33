"""Every registered query against DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point

from .oracle_check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        assert result.count() >= 0
        return
    assert compare(result, con, SQL[name]) == []


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 3

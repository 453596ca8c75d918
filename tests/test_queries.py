"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, queries
from tools.compare import connect, difference, rows_of_spark, rows_of_sql
from workload.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_entry(spark):
    rows = entry(spark)
    assert "adj_close" in rows.columns and not rows.isEmpty()


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    ours = rows_of_spark(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert difference(ours, rows_of_sql(tables, ORACLES[name])) is None
    else:
        assert ours[1]

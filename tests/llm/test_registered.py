"""Every operator has its query; SQL agrees where there is any."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from barloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, difference, rows_of_spark, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours = rows_of_spark(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert difference(ours, rows_of_sql(connect(FOLDER), ORACLES[name])) is None
    else:
        assert len(ours[1]) == 200

"""Queries of the add-on that SQL can express, against that SQL."""

import pytest

from check import compare, connect
from mailweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    diff, rows = compare(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert diff is None and rows > 0, diff

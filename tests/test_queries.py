"""Every registered query against its SQL check, on the smallest data."""

import os

import pytest

from check import ROOT, compare, connect
from mailweave.registry import QUERIES, oracle_sql

SF_DIR = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR), oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    con, checks = duck
    diff, _ = compare(spark, con, name, QUERIES[name], checks.get(name), SF_DIR)
    assert diff is None, diff


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

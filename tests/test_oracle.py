"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    state, rows, note = compare(spark, con, SF, name)
    assert state in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0

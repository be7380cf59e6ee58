"""Every registered query that SQL can express gives the same columns, types and rows as its SQL."""

import pytest

import __spark_entry__ as entry
from tests import parity

SF = "/root/testdata/sf0.001"
#: Rows that so small an input does not have.
MAY_BE_EMPTY = {"session_resume", "lookup_by_code"}


@pytest.fixture(scope="module")
def con():
    return parity.oracle(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    found = parity.differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert found == [] or name in MAY_BE_EMPTY and found == ["no rows"]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_runs_without_sql(spark, name):
    if not name.startswith("op"):
        assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

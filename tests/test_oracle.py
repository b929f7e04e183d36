"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = entry.SMOKE_DIR
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, same, note = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert same is not False, note
    assert rows >= 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["turn_count", "conversations", "pairs"] and not result.isEmpty()

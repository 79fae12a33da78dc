"""Every named query gives the same rows as its SQL oracle."""

import pytest

import __spark_entry__ as entry
from compare import oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, name):
    columns, got = spark_rows(QUERIES[name](spark, SF_DIR))
    if name not in ORACLES:
        assert sum(got.values()) > 0
        return
    expected_columns, want = oracle_rows(ORACLES[name], SF_DIR)
    assert columns == expected_columns
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0

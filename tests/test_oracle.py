"""Every registered job with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import __spark_entry__ as E
from support import SF_SMALL
from oracle_check import compare, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, con, key):
    ok, msg, _ = compare(spark, con, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "equipment_id" in df.columns

"""Every registered query with a SQL twin equals DuckDB on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, entry.queries()[name], ORACLE[name], SF)
    assert r["ok"], r


def test_every_query_registered_has_callable():
    qs = entry.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 73


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert [f.name for f in df.schema.fields] == ["factor", "factor_value", "rank", "word", "pearson_correlation",
                                                  "word_count"]
    assert df.count() > 0

"""A sample of registered queries against DuckDB on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canonical

SAMPLE = ["variance_retention_summary", "seasonal_naive", "dm_table", "exceedance_table", "unpivot_daily_wide", "rank_reversal_table", "regime_skill_summary"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    left = entry.queries()[name](spark, sf_dir).toPandas()
    right = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(left.columns) == sorted(right.columns)
    a, b = canonical(left), canonical(right)
    assert len(a) == len(b) and a.equals(b)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

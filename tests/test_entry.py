import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() == 45 and "rank" in df.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(oracle_sql()) >= 69


@pytest.mark.parametrize("name", ["hourly_grid_by_user", "metrics_by_model", "best_strategy", "kpss"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        tuple(r[i] for i in order) for r in want.fetchall())

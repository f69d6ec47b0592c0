import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows

DIR = "/root/testdata/sf0.001"
SAMPLE = ("resample_week", "outliers_iqr", "moving_average_convergence", "feature_table", "triple_barrier_long", "cooled_signals", "trade_ledger", "return_figures", "multiclass_areas", "fold_members")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns and out.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

"""Every registered query against its SQL twin on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from seriesward import params

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        cur = duck.execute(SQL[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, cur.fetchall())


#: Queries over ordered series, whose long ones are cut where a task may hold few rows.
ORDERED = (
    "w1_running_stats w2_recent_quartiles w3_w11_extract_features w12_training_features w13_rolling_bands w14_sequences w15_expected_range "
    "d1_statistical_check d3_given_forest d6_given_sequence d10_given_ensemble l1_process_anomaly l6_l7_actions"
).split()


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_a_limit_that_cuts(spark, name):
    """The same rows when every series of the larger tables is cut."""
    data, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"create view events as select * from '{data}/events.parquet'")
    spark.conf.set(params.ROWS_PER_TASK_CONF, "60")
    try:
        df = QUERIES[name](spark, data)
        got = rows_of(df.columns, df.collect())
    finally:
        spark.conf.unset(params.ROWS_PER_TASK_CONF)
    cur = con.execute(SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

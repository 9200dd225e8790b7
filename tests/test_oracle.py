"""Registered queries against an independent engine on the given tables.

``tools/check_oracle.py`` compares all of them; here one of each kind runs.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows

ROOT = "/root/testdata/sf0.001"
KINDS = ("dim_date_extend", "vw_funnel_weekly", "vw_orders_trend", "events_wtd", "revenue_yoy",
         "funnel_yoy", "funnel_snapshot", "funnel_anomalies_weeks", "weekly_trend_revenue",
         "running_total_multi", "top_product_weeks", "period_changes_month", "daily_trend_summary",
         "as_of_resolve", "cross_spec_read", "contract_check")


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for table in TABLES:
        held.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return held


@pytest.mark.parametrize("name", KINDS)
def test_query_matches_its_sql(spark, con, name):
    frame = entry.queries()[name](spark, ROOT)
    got = rows(frame.columns, frame.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

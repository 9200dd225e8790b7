"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

Each query is planned and run from its source files.  ``cold`` is its first run in the
session, ``queries`` the median of three more, and ``value`` their sum.  The versioned dataset is
written once per session, which ``publish_sec`` tells apart; ``added`` holds queries that joined
later and are no part of ``value``, so that it means the same in every round.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stagewise.entry.extended import QUERIES
from stagewise.entry.published import published
from stagewise.entry.queries import all_queries
from stagewise.session import build_session

HEADLINE = (
    "vw_funnel_weekly", "vw_funnel_stage_trend", "vw_orders_trend", "orders_wtd", "events_ytd",
    "revenue_yoy", "funnel_yoy", "funnel_snapshot", "funnel_snapshot_week",
    "funnel_anomalies_weeks", "weekly_trend_lead", "running_total_multi", "top_product",
    "top_region_weeks", "period_compare_month", "daily_trend", "compare_as_of", "read_snapshot",
    "stored_funnel_weekly", "stored_funnel_snapshot", "cross_spec_read", "contract_check",
)
ADDED = ("csv_rejects", "as_of_sorted", "compare_as_of_all", "period_changes_all", "top_product_periods", "fk_suspects", "serve_fingerprint")
RUNS = 3


def seconds(spark, build, root: str) -> tuple[float, float]:
    def once() -> float:
        start = time.perf_counter()
        build(spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    return once(), statistics.median(once() for _ in range(RUNS))


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    published(spark, root)
    publish = time.perf_counter() - start
    queries = all_queries() | QUERIES
    names = sys.argv[1:] or HEADLINE
    timed = {name: [round(x, 4) for x in seconds(spark, queries[name], root)] for name in names}
    warm = {name: t[1] for name, t in timed.items()}
    added = {} if sys.argv[1:] else {name: round(seconds(spark, queries[name], root)[1], 4) for name in ADDED}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 4), "unit": "sec",
        "queries": warm, "cold": {name: t[0] for name, t in timed.items()}, "sf": root.rstrip("/").rsplit("sf", 1)[-1],
        "publish_sec": round(publish, 3), "added": added}))


if __name__ == "__main__":
    main()

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagewise.functions.calendar import calendar
from stagewise.schemas import DIM_CHANNEL, DIM_CUSTOMER, DIM_PRODUCT, FACT_FUNNEL_EVENT, FACT_ORDERS
from stagewise.session import build_session
from stagewise.star import Star


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def make_star(spark, first: str, last: str, events=(), orders=()) -> Star:
    """``events`` are ``(day, stage, count)``; ``orders`` are
    ``(day, revenue[, product_key[, customer_key]])``."""
    lo = day(first)

    def key(d: str) -> int:
        return (day(d) - lo).days

    def at(d: str) -> dt.datetime:
        return dt.datetime.combine(day(d), dt.time(12), dt.timezone.utc)

    rows, n = [], 0
    for d, stage, count in events:
        for _ in range(count):
            rows.append((n, key(d), n % 3, n % 2, stage, at(d)))
            n += 1
    lines = []
    for i, (d, revenue, *rest) in enumerate(orders):
        product = rest[0] if rest else 0
        customer = rest[1] if len(rest) > 1 else 0
        lines.append((i, key(d), customer, 0, product, float(revenue), 1, at(d)))

    dates = calendar(spark, lo, day(last))
    return Star(
        dim_date=dates,
        dim_customer=spark.createDataFrame(
            [(i, f"c{i}", f"Name {i}", ["SMB", "Enterprise", "SMB"][i],
              ["North", "South", "North"][i], lo) for i in range(3)], DIM_CUSTOMER),
        dim_channel=spark.createDataFrame([(0, "Email", "Organic"), (1, "Paid Search", "Paid")],
                                          DIM_CHANNEL),
        dim_product=spark.createDataFrame(
            [(0, "Starter", "Software", 29.0), (1, "Pro", "Software", 99.0),
             (2, "Pro", "Software", 109.0), (3, "Alpha", "Software", 10.0)], DIM_PRODUCT),
        fact_funnel_event=spark.createDataFrame(rows, FACT_FUNNEL_EVENT),
        fact_orders=spark.createDataFrame(lines, FACT_ORDERS))


@pytest.fixture
def star_of(spark):
    return lambda *a, **k: make_star(spark, *a, **k)


def files_opened(frame: DataFrame) -> list[int]:
    """``numFiles`` of every file scan in the plan of ``frame``, after running it."""
    jvm_frame = frame._jdf
    jvm_frame.queryExecution().toRdd().count()
    plan = jvm_frame.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numFiles")
        if metric.isDefined() and kind == "FileSourceScanExec":
            found.append(metric.get().value())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return sorted(found)

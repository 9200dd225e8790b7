"""Fifteen named queries: running totals, week over week and year over year.

Every one is a roll-up of a daily or weekly aggregate; the sorts run on calendar
rows, never on facts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.ratios import change
from stagewise.plans.daily import (WEEK, daily_events, daily_orders, shifted_year,
                                   weekly_events, weekly_orders)
from stagewise.star import Star

# where a running total starts again
RESETS = {"wtd": WEEK, "mtd": ("year", "month"), "ytd": ("year",)}


def running(daily: DataFrame, value: str, period: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``running_total`` of ``value`` by date, starting again with each period."""
    window = (Window.partitionBy(*by, *RESETS[period]).orderBy("date")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.withColumn("running_total", F.sum(value).over(window))


def _running_events(star: Star, period: str) -> DataFrame:
    total = running(daily_events(star), "events", period, by=("stage",))
    return (total.select("date", "stage", "events",
                         F.col("running_total").alias(f"running_events_{period}"))
            .orderBy("stage", "date"))


def _running_orders(star: Star, measure: str, period: str) -> DataFrame:
    total = running(daily_orders(star), measure, period)
    kind = "double" if measure == "revenue" else "bigint"
    return (total.select("date", F.col(measure).cast(kind).alias(measure),
                         F.col("running_total").cast(kind).alias(f"running_{measure}_{period}"))
            .orderBy("date"))


def _wow(weekly: DataFrame, measure: str, by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(*WEEK)
    prior = f"{measure}_prior_week"
    return (weekly.select(*by, *WEEK, measure, F.lag(measure).over(order).alias(prior))
            .withColumn("wow_pct", change(F.col(measure), F.col(prior)))
            .orderBy(*by, *WEEK))


def _yoy(weekly: DataFrame, measure: str, by: tuple[str, ...] = ()) -> DataFrame:
    prior = f"{measure}_last_year"
    return (weekly.join(shifted_year(weekly, {measure: prior}, by), [*by, *WEEK], "left")
            .select(*by, "iso_week", "iso_year", measure, prior,
                    change(F.col(measure), F.col(prior)).alias("yoy_pct"))
            .orderBy(*by, "iso_week", "iso_year"))


def catalogue() -> dict[str, Callable[[Star], DataFrame]]:
    named: dict[str, Callable[[Star], DataFrame]] = {}
    for period in RESETS:
        named[f"orders_{period}"] = lambda s, p=period: _running_orders(s, "orders", p)
    for period in RESETS:
        named[f"events_{period}"] = lambda s, p=period: _running_events(s, p)
    for period in RESETS:
        named[f"revenue_{period}"] = lambda s, p=period: _running_orders(s, "revenue", p)
    named["orders_wow"] = lambda s: _wow(weekly_orders(s), "orders")
    named["orders_yoy"] = lambda s: _yoy(weekly_orders(s), "orders")
    named["events_wow"] = lambda s: _wow(weekly_events(s), "events", ("stage",))
    named["events_yoy"] = lambda s: _yoy(weekly_events(s), "events", ("stage",))
    named["revenue_wow"] = lambda s: _wow(weekly_orders(s), "revenue")
    named["revenue_yoy"] = lambda s: _yoy(weekly_orders(s), "revenue")
    return named


def run_catalogue(star: Star) -> DataFrame:
    """Run every query and report its row count, or its error.

    All counts are one job, as each is one row of it.  One failing query does not stop the others:
    where the job fails, its queries are run one by one to find out which.  The daily aggregates are
    kept for the length of the job, so each fact is read once and not per query.
    """
    rows, counts = [], {}
    with star.kept() as held:
        for name, build in catalogue().items():
            try:
                counts[name] = build(held).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
            except Exception as error:  # the report is the point of this job
                rows.append((name, None, False, str(error)))
        try:
            rows += [(r.name, r.n, True, None) for r in reduce(DataFrame.unionByName, counts.values()).collect()] if counts else []
        except Exception:
            for name, count in counts.items():
                try:
                    rows.append((name, count.first().n, True, None))
                except Exception as error:
                    rows.append((name, None, False, str(error)))
    order = list(catalogue())
    rows.sort(key=lambda r: order.index(r[0]))
    return star.spark.createDataFrame(rows, "name string, row_count long, ok boolean, error string")

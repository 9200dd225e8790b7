"""Ranking a dimension by orders, revenue or average deal size.

Facts are first aggregated by the dimension key, so the dimension meets one row
per key and a key that holds a third of the facts is one row per task.  The
dimension side carries no broadcast hint: customers and products grow with the
data, and the engine broadcasts them only where their size allows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.errors import MetricError
from stagewise.functions.calendar import week_label
from stagewise.functions.ratios import half_up
from stagewise.operators.arguments import how_many
from stagewise.operators.measures import ORDERS
from stagewise.operators.provenance import provenance
from stagewise.operators.weeks import resolve_week
from stagewise.plans.daily import WEEK, money_sum, spine
from stagewise.star import Star

# dimension -> table, key, label
DIMENSIONS = {
    "channel": ("dim_channel", "channel_key", "channel_name"),
    "product": ("dim_product", "product_key", "product_name"),
    "region": ("dim_customer", "customer_key", "region"),
    "segment": ("dim_customer", "customer_key", "segment"),
}
RANKED = ("orders", "revenue", "avg_deal_size")


def _check(dimension: str, measure: str) -> None:
    if dimension not in DIMENSIONS:
        raise MetricError(f"dimension must be one of {', '.join(DIMENSIONS)}, got {dimension!r}")
    if measure not in RANKED:
        raise MetricError(f"measure must be one of {', '.join(RANKED)}, got {measure!r}")


def _labelled(star: Star, dimension: str, facts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Orders and revenue per label; labels shared by several keys merge."""
    table, key, label = DIMENSIONS[dimension]
    per_key = facts.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"),
                                          money_sum().alias("amount"))
    names = star.table(table).select(key, F.col(label).alias("name"))
    return (per_key.join(names, key).groupBy(*by, "name")
            .agg(F.sum("n").alias("orders"), F.sum("amount").cast("double").alias("revenue")))


def _ranked(frame: DataFrame, measure: str) -> DataFrame:
    """The value to order by, at full precision, next to the figures shown."""
    average = F.col("revenue") / F.col("orders").cast("double")
    exact: dict[str, Column] = {"orders": F.col("orders").cast("double"),
                                "revenue": F.col("revenue"), "avg_deal_size": average}
    return frame.withColumn("avg_deal_size", average).withColumn("exact", exact[measure])


def _shown() -> list[Column]:
    return [half_up(F.col("exact"), 2).alias("value"), F.col("orders"),
            half_up(F.col("revenue"), 2).alias("revenue"),
            half_up(F.col("avg_deal_size"), 2).alias("avg_deal_size")]


def _receipts(star: Star, dimension: str, measure: str, limit: int, start: Column,
              now: dt.datetime | None) -> Column:
    table, _, label = DIMENSIONS[dimension]
    return provenance(star.snapshots, [ORDERS], ["dim_date", table],
                      f"{measure} per {label} in the ISO week, highest first, top {limit}; "
                      "avg_deal_size = revenue / order lines",
                      start, F.date_add(start, 6), now=now)


def top_dimension(star: Star, dimension: str = "channel", measure: str = "orders",
                  iso_year: int | None = None, iso_week: int | None = None, limit: int = 5,
                  now: dt.datetime | None = None) -> DataFrame:
    """The highest labels of one week; equal values are ordered by name."""
    _check(dimension, measure)
    limit = how_many("limit", limit)
    week = resolve_week(star, iso_year, iso_week)
    facts = star.on_days("fact_orders", week.date_keys)
    top = (_ranked(_labelled(star, dimension, facts, ()), measure)
           .orderBy(F.desc("exact"), "name").limit(limit))
    return top.select(F.lit(week.label).alias("week"), "name", *_shown(),
                      _receipts(star, dimension, measure, limit,
                                F.lit(week.week_start_date), now))


def top_dimension_all(star: Star, dimension: str = "channel", measure: str = "orders",
                      limit: int = 5, now: dt.datetime | None = None) -> DataFrame:
    """The highest labels of every week."""
    _check(dimension, measure)
    limit = how_many("limit", limit)
    # the calendar is joined first: grouping by day and key would give the
    # shuffle up to seven times the rows
    days = spine(star).select("date_key", *WEEK, "week_start_date")
    weekly = star.fact_orders.join(days, "date_key")
    labelled = _labelled(star, dimension, weekly, (*WEEK, "week_start_date"))
    order = Window.partitionBy(*WEEK).orderBy(F.desc("exact"), F.col("name"))
    return (_ranked(labelled, measure).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit)
            .select(week_label(F.col("iso_year"), F.col("iso_week")).alias("week"), "rank",
                    "name", *_shown(),
                    _receipts(star, dimension, measure, limit, F.col("week_start_date"), now)))

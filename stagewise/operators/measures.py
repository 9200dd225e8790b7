"""The one mapping from a measure to its table, aggregate and filter."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.plans.daily import daily_events, daily_orders
from stagewise.schemas import STAGES
from stagewise.star import Star

FUNNEL, ORDERS = "fact_funnel_event", "fact_orders"


def source_of(measure: str) -> str:
    return FUNNEL if measure in STAGES else ORDERS


def daily(star: Star, measure: str) -> DataFrame:
    """Days of a measure as the parts a value is made of at any grain: ``n`` and ``amount``."""
    if measure in STAGES:
        frame = daily_events(star, [measure])
        n, amount = F.col("events"), F.lit(None).cast("decimal(28,4)")
    else:
        frame = daily_orders(star)
        n, amount = F.col("orders"), F.col("revenue")
    return frame.select("date", "year", "quarter", "month", "iso_year", "iso_week",
                        "week_start_date", "is_complete_week",
                        n.alias("n"), amount.alias("amount"))


def value_of(measure: str, n: Column, amount: Column) -> Column:
    """The value made of a count and an amount, rolled up or not."""
    if measure == "revenue":
        return amount.cast("double")
    if measure == "avg_deal_size":
        return amount.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    return n.cast("double")


def daily_values(star: Star, measures: Collection[str]) -> DataFrame:
    """``(measure, date, ..., value)`` for additive measures, each fact read once.

    ``value`` is decimal, so that it can be summed further without rounding.
    """
    stages = [m for m in measures if m in STAGES]
    sales = [m for m in measures if m not in STAGES]
    keep = ("date", "year", "month", "iso_year", "iso_week")
    parts = []
    if stages:
        parts.append(daily_events(star, stages).select(
            F.col("stage").alias("measure"), *keep,
            F.col("events").cast("decimal(28,4)").alias("value")))
    if sales:
        pairs = [F.struct(F.lit(m).alias("measure"),
                          F.col(m).cast("decimal(28,4)").alias("value")) for m in sales]
        parts.append(daily_orders(star)
                     .select(*keep, F.inline(F.array(*pairs)))
                     .select("measure", *keep, "value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

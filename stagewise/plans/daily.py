"""Daily aggregates of the facts: the only plans that read a fact table.

Each fact is first aggregated by its own key columns, with map-side partial
aggregation, and only the result (days x stages rows) meets the calendar.  A hot
day or stage therefore costs one partial row per task, no fact row is ever
joined or shuffled, and every week, month, quarter and year rolls up from here.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.schemas import MONEY
from stagewise.star import Star

WEEK = ("iso_year", "iso_week")
_SPINE = ("date_key", "date", "year", "quarter", "month", *WEEK,
          "week_start_date", "is_complete_week")


def money_sum(column: str = "revenue") -> Column:
    return F.sum(F.col(column).cast(MONEY))


def spine(star: Star) -> DataFrame:
    """Calendar days with the start and completeness of the week they are in."""
    week = Window.partitionBy(*WEEK)
    return (star.dim_date
            .withColumn("is_complete_week", F.count(F.lit(1)).over(week) == 7)
            .withColumn("week_start_date", F.min("week_start_date").over(week))
            .select(*_SPINE))


def _only_days(frame: DataFrame, keys: Collection[int] | None) -> DataFrame:
    return frame if keys is None else frame.filter(F.col("date_key").isin(*keys))


def _count_events(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key", "stage").agg(F.count(F.lit(1)).alias("events"))


def _count_orders(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key").agg(F.count(F.lit(1)).alias("orders"),
                                        money_sum().alias("revenue"),
                                        F.sum("quantity").alias("units"))


def _on_calendar(star: Star, counted: DataFrame) -> DataFrame:
    return counted.join(spine(star), "date_key").drop("date_key")


def daily_events(star: Star, stages: Collection[str] | None = None,
                 keys: Collection[int] | None = None) -> DataFrame:
    """Events per day and stage."""
    kept = star.keep("events", lambda: _count_events(star.fact_funnel_event))
    rows = star.on_days("fact_funnel_event", keys) if kept is None else _only_days(kept, keys)
    if stages is not None:
        rows = rows.filter(F.col("stage").isin(*stages))
    return _on_calendar(star, _count_events(rows) if kept is None else rows)


def daily_stages(star: Star, keys: Collection[int] | None = None) -> DataFrame:
    """Events per day with one column per stage: a third of the rows of the long form."""
    kept = star.keep("events", lambda: _count_events(star.fact_funnel_event))
    rows = star.on_days("fact_funnel_event", keys) if kept is None else _only_days(kept, keys)
    columns = []
    for stage, name in (("visit", "visits"), ("lead", "leads"), ("opportunity", "opportunities")):
        of_stage = F.col("stage") == stage
        counted = (F.count_if(of_stage) if kept is None
                   else F.sum(F.when(of_stage, F.col("events")).otherwise(0)))
        columns.append(counted.alias(name))
    return _on_calendar(star, rows.groupBy("date_key").agg(*columns))


def daily_orders(star: Star, keys: Collection[int] | None = None) -> DataFrame:
    """Order lines, revenue and units per day; revenue stays decimal for rolling up."""
    kept = star.keep("orders", lambda: _count_orders(star.fact_orders))
    if kept is not None:
        return _on_calendar(star, _only_days(kept, keys))
    return _on_calendar(star, _count_orders(star.on_days("fact_orders", keys)))


def _by_week(daily: DataFrame, *measures: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """Roll days up to weeks.

    Start and completeness are the same on every day of a week, so they are
    aggregated and not grouped by: the result stays hash-partitioned on the week
    key alone, which the joins that follow can use without another shuffle.
    """
    return daily.groupBy(*WEEK, *also).agg(
        F.min("week_start_date").alias("week_start_date"),
        F.min("is_complete_week").alias("is_complete_week"), *measures)


def weekly_events(star: Star, stages: Collection[str] | None = None,
                  keys: Collection[int] | None = None) -> DataFrame:
    return _by_week(daily_events(star, stages, keys),
                    F.sum("events").alias("events"), also=("stage",))


def weekly_stages(star: Star, keys: Collection[int] | None = None) -> DataFrame:
    return _by_week(daily_stages(star, keys),
                    *[F.sum(c).alias(c) for c in ("visits", "leads", "opportunities")])


def weekly_orders(star: Star, keys: Collection[int] | None = None) -> DataFrame:
    return _by_week(daily_orders(star, keys),
                    F.sum("orders").alias("orders"),
                    F.sum("revenue").cast("double").alias("revenue"),
                    F.sum("units").alias("units"))


def shifted_year(weekly: DataFrame, keep: dict[str, str], by: Collection[str] = ()) -> DataFrame:
    """The weekly rows re-keyed to the week one ISO year later, columns renamed by ``keep``.

    Joining on it pairs a week with the same week of the year before, or with
    nothing; an ordering function would pair it with whichever year is present.
    """
    return weekly.select(*by, (F.col("iso_year") + 1).alias("iso_year"), "iso_week",
                         *[F.col(old).alias(new) for old, new in keep.items()])

"""The six governed views, as frames and as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.ratios import change, share
from stagewise.plans.daily import (WEEK, shifted_year, weekly_events, weekly_orders,
                                   weekly_stages)
from stagewise.schemas import TABLES
from stagewise.star import Star

_WEEK_OUT = (*WEEK, "week_start_date", "is_complete_week")


def vw_week(star: Star) -> DataFrame:
    """The week spine.  A week at the edge of the calendar shows fewer than seven days."""
    return (star.dim_date.groupBy(*WEEK)
            .agg(F.min("week_start_date").alias("week_start_date"),
                 F.min("date").alias("first_date_observed"),
                 F.max("date").alias("last_date_observed"),
                 F.count(F.lit(1)).alias("days_observed"))
            .withColumn("is_complete_week", F.col("days_observed") == 7))


def vw_weekly_funnel(star: Star) -> DataFrame:
    return weekly_events(star).select(*_WEEK_OUT, "stage", "events")


def vw_weekly_orders(star: Star) -> DataFrame:
    return weekly_orders(star).select(*_WEEK_OUT, "orders", "revenue", "units")


def funnel_weeks(stages: DataFrame, orders: DataFrame) -> DataFrame:
    """Weeks that saw any event, with their orders and stage-to-stage conversion."""
    joined = stages.join(orders.select(*WEEK, "orders", "revenue"), list(WEEK), "left")
    n = F.coalesce("orders", F.lit(0).cast("bigint"))
    return joined.select(
        *_WEEK_OUT, "visits", "leads", "opportunities",
        n.alias("orders"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        share(F.col("leads"), F.col("visits")).alias("visit_to_lead_pct"),
        share(F.col("opportunities"), F.col("leads")).alias("lead_to_opp_pct"),
        share(n, F.col("opportunities")).alias("opp_to_order_pct"),
        share(n, F.col("visits")).alias("visit_to_order_pct"))


def vw_funnel_weekly(star: Star) -> DataFrame:
    return funnel_weeks(weekly_stages(star), weekly_orders(star))


def vw_funnel_stage_trend(star: Star) -> DataFrame:
    weekly = weekly_events(star)
    order = Window.partitionBy("stage").orderBy(*WEEK)
    prior = shifted_year(weekly, {"events": "events_last_year"}, by=["stage"])
    return (weekly.withColumn("events_prior_week", F.lag("events").over(order))
            .join(prior, ["stage", *WEEK], "left")
            .select("stage", *_WEEK_OUT, "events", "events_prior_week",
                    change(F.col("events"), F.col("events_prior_week")).alias("wow_pct"),
                    "events_last_year",
                    change(F.col("events"), F.col("events_last_year")).alias("yoy_pct")))


def vw_orders_trend(star: Star) -> DataFrame:
    """The ordering window runs over weekly rows: some fifty per calendar year."""
    weekly = weekly_orders(star)
    order = Window.orderBy(*WEEK)
    prior = shifted_year(weekly, {"orders": "orders_last_year", "revenue": "revenue_last_year"})
    frame = (weekly.withColumn("orders_prior_week", F.lag("orders").over(order))
             .withColumn("revenue_prior_week", F.lag("revenue").over(order))
             .join(prior, list(WEEK), "left"))

    def moved(measure: str, base: str):
        return change(F.col(measure), F.col(f"{measure}_{base}"))

    return frame.select(
        *_WEEK_OUT, "orders", "revenue", "orders_prior_week", "revenue_prior_week",
        moved("orders", "prior_week").alias("orders_wow_pct"),
        moved("revenue", "prior_week").alias("revenue_wow_pct"),
        "orders_last_year", "revenue_last_year",
        moved("orders", "last_year").alias("orders_yoy_pct"),
        moved("revenue", "last_year").alias("revenue_yoy_pct"))


VIEWS = {
    "vw_week": vw_week,
    "vw_weekly_funnel": vw_weekly_funnel,
    "vw_weekly_orders": vw_weekly_orders,
    "vw_funnel_weekly": vw_funnel_weekly,
    "vw_funnel_stage_trend": vw_funnel_stage_trend,
    "vw_orders_trend": vw_orders_trend,
}


def publish_views(star: Star) -> list[str]:
    """Register the tables and then the views over them as temporary views.

    Replacing a temporary view needs no drop, so the order is simply base first.
    """
    for name in TABLES:
        star.table(name).createOrReplaceTempView(name)
    for name, build in VIEWS.items():
        build(star).createOrReplaceTempView(name)
    return [*TABLES, *VIEWS]

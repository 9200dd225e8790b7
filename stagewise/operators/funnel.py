"""The funnel in one week: against last year, by stage, and where it fell.

The ``*_all`` forms answer for every week in one job.  The single forms resolve
the week first and filter the facts by its day keys, so only those days are read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.errors import MetricError
from stagewise.functions.calendar import week_label
from stagewise.functions.ratios import change, direction, half_up, share
from stagewise.operators.arguments import stage_name
from stagewise.operators.measures import FUNNEL, ORDERS
from stagewise.operators.provenance import provenance
from stagewise.operators.weeks import Week, resolve_week, week_containing, week_table
from stagewise.plans.daily import WEEK, weekly_events, weekly_orders, weekly_stages
from stagewise.star import Star

ANOMALY_THRESHOLD = 20.0


# --- against the same ISO week last year -------------------------------------

def _yoy(star: Star, weekly: DataFrame, now: dt.datetime | None) -> DataFrame:
    prior = weekly.select("stage", (F.col("iso_year") + 1).alias("iso_year"), "iso_week",
                          F.col("events").alias("prior_year_events"))
    # the prior week's dates come from the calendar: 52 weeks back is a week off
    # across a year of 53
    calendar = week_table(star).select(
        (F.col("iso_year") + 1).alias("iso_year"), "iso_week",
        F.col("week_start_date").alias("prior_start"), F.col("week_end").alias("prior_end"))
    current, before = F.col("current_events"), F.col("prior_year_events")
    pct = change(current, before)
    year, number = F.col("iso_year"), F.col("iso_week")
    return (
        weekly.withColumnRenamed("events", "current_events")
        .join(prior, ["stage", *WEEK], "left")
        .join(calendar, list(WEEK), "left")
        .select("stage", *WEEK, week_label(year, number).alias("week"), "week_start_date",
                "current_events", week_label(year - 1, number).alias("prior_year_week"),
                "prior_year_events", (current - before).alias("delta"),
                pct.alias("yoy_pct"), direction(pct).alias("direction"),
                F.when(before.isNull(), F.format_string(
                    "week %d of %d holds no data, so the change over the year is "
                    "unknown rather than zero", number, year - 1)).alias("note"),
                provenance(star.snapshots, [FUNNEL], ["dim_date"],
                           "events of the stage in the ISO week against the same ISO week of "
                           "the year before; yoy_pct = 100 * (current - prior) / prior",
                           F.col("week_start_date"), F.date_add("week_start_date", 6),
                           F.col("prior_start"), F.col("prior_end"), now=now)))


def funnel_yoy_all(star: Star, now: dt.datetime | None = None) -> DataFrame:
    """Every stage and week that has events."""
    return _yoy(star, weekly_events(star), now)


def funnel_yoy(star: Star, stage: str, iso_year: int | None = None, iso_week: int | None = None,
               now: dt.datetime | None = None) -> DataFrame:
    """One stage and week; no row if the week has no such events."""
    stage = stage_name(stage)
    week = resolve_week(star, iso_year, iso_week)
    try:
        prior = resolve_week(star, week.iso_year - 1, week.iso_week).date_keys
    except MetricError:  # unknown, not zero: the join below leaves it null
        prior = ()
    weekly = weekly_events(star, [stage], [*week.date_keys, *prior])
    return _yoy(star, weekly, now).filter(_is(week))


def _is(week: Week) -> Column:
    return (F.col("iso_year") == week.iso_year) & (F.col("iso_week") == week.iso_week)


# --- the whole funnel ---------------------------------------------------------

STEPS = (("visit", "lead"), ("lead", "opportunity"), ("opportunity", "order"))


def _counts(star: Star, keys: list[int] | None = None) -> DataFrame:
    """Stage counts, orders and revenue of weeks that saw a visit."""
    orders = weekly_orders(star, keys).select(*WEEK, "orders", "revenue")
    return (weekly_stages(star, keys).join(orders, list(WEEK), "left")
            .filter(F.col("visits") > 0)
            .select(*WEEK, "week_start_date", "is_complete_week",
                    F.col("visits").alias("visit"), F.col("leads").alias("lead"),
                    F.col("opportunities").alias("opportunity"),
                    F.coalesce("orders", F.lit(0).cast("bigint")).alias("order"),
                    half_up(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue")))


def _conversions() -> list[Column]:
    pairs = [*STEPS, ("visit", "order")]
    return [share(F.col(down), F.col(up)).alias(f"{up}_to_{down}_pct") for up, down in pairs]


def _drop_offs() -> list[Column]:
    return [share(F.col(up) - F.col(down), F.col(up)).alias(f"{up}_to_{down}_drop_pct")
            for up, down in STEPS]


def _snapshot(star: Star, counts: DataFrame, now: dt.datetime | None) -> DataFrame:
    return counts.select(
        *WEEK, week_label(F.col("iso_year"), F.col("iso_week")).alias("week"),
        "week_start_date", "is_complete_week", "visit", "lead", "opportunity", "order",
        "revenue", *_conversions(), *_drop_offs(),
        provenance(star.snapshots, [FUNNEL, ORDERS], ["dim_date"],
                   "counts per stage in the ISO week; conversion = 100 * downstream / upstream; "
                   "drop-off = 100 * (upstream - downstream) / upstream",
                   F.col("week_start_date"), F.date_add("week_start_date", 6), now=now))


def funnel_snapshot_all(star: Star, now: dt.datetime | None = None) -> DataFrame:
    return _snapshot(star, _counts(star), now)


def funnel_snapshot(star: Star, iso_year: int | None = None, iso_week: int | None = None,
                    now: dt.datetime | None = None) -> DataFrame:
    """One week; no row if it saw no visit."""
    week = resolve_week(star, iso_year, iso_week)
    return _snapshot(star, _counts(star, list(week.date_keys)), now)


# --- what fell since the week before -------------------------------------------

def _figures(counts: DataFrame) -> DataFrame:
    """One row per week and figure: four volumes and four conversion rates."""
    rates = counts.select("*", *_conversions())

    def entry(kind: str, name: str, label: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"),
                        F.lit(label).alias("label"), value.cast("double").alias("current"))

    volumes = [entry("stage_volume", s, f"{s} volume", F.col(s))
               for s in ("visit", "lead", "opportunity", "order")]
    steps = [entry("conversion_rate", f"{a}_to_{b}", f"{a} → {b} conversion",
                   F.col(f"{a}_to_{b}_pct")) for a, b in [*STEPS, ("visit", "order")]]
    return rates.select(*WEEK, "week_start_date", F.inline(F.array(*volumes, *steps)))


def _message() -> Column:
    drop = half_up(F.abs("change_pct"), 0).cast("bigint")
    volume = F.format_string("%s: down %d%% (%,d before, %,d now)", F.col("label"), drop,
                             F.col("previous").cast("bigint"), F.col("current").cast("bigint"))
    rate = F.format_string("%s: down %d%% (%.1f%% before, %.1f%% now)", F.col("label"), drop,
                           half_up(F.col("previous"), 1), half_up(F.col("current"), 1))
    return F.when(F.col("kind") == "conversion_rate", rate).otherwise(volume)


def _fallen(star: Star, counts: DataFrame, threshold: float,
            now: dt.datetime | None) -> DataFrame:
    """Weeks against the week that starts seven days earlier, drops only."""
    current = _figures(counts)
    before = current.select(
        F.date_add("week_start_date", 7).alias("week_start_date"),
        week_label(F.col("iso_year"), F.col("iso_week")).alias("previous_week"),
        "kind", "name", F.col("current").alias("previous"))
    start = F.col("week_start_date")
    return (
        current.join(before, ["week_start_date", "kind", "name"])
        .withColumn("change_pct", change(F.col("current"), F.col("previous")))
        .filter(F.col("change_pct") <= -threshold)
        .select(week_label(F.col("iso_year"), F.col("iso_week")).alias("current_week"),
                "previous_week", "kind", "name", "label", "current", "previous", "change_pct",
                _message().alias("message"),
                provenance(star.snapshots, [FUNNEL, ORDERS], ["dim_date"],
                           "each figure of a week, a count or a ratio of counts, beside the same figure seven "
                           f"days earlier; a row where it lost {threshold:g} % or more of that",
                           start, F.date_add(start, 6), F.date_sub(start, 7),
                           F.date_sub(start, 1), now=now)))


def funnel_anomalies_all(star: Star, threshold_pct: float | None = None,
                         now: dt.datetime | None = None) -> DataFrame:
    """Every week that fell by the threshold or more in some figure."""
    return _fallen(star, _counts(star), _threshold(threshold_pct), now)


def funnel_anomaly_report(star: Star, threshold_pct: float | None = None, now: dt.datetime | None = None) -> DataFrame:
    """One row per week whatever happened: how many figures fell, the steepest of them, and the reason if none is named."""
    threshold = _threshold(threshold_pct)
    current = _figures(_counts(star))
    label = week_label(F.col("iso_year"), F.col("iso_week"))
    before = current.select(F.date_add("week_start_date", 7).alias("week_start_date"), label.alias("previous_week"), "kind", "name",
                            F.col("current").alias("previous"))
    both = (current.withColumn("current_week", label).join(before, ["week_start_date", "kind", "name"], "left")
            .withColumn("change_pct", change(F.col("current"), F.col("previous"))))
    fell = F.col("change_pct") <= -threshold
    steepest = F.min(F.when(fell, F.struct("change_pct", "kind", "name")))
    weeks = both.groupBy("week_start_date", "current_week").agg(
        F.max("previous_week").alias("previous_week"), F.count_if(fell).alias("fallen"), steepest.alias("worst"))
    start = F.col("week_start_date")
    return weeks.select(
        "current_week", "previous_week", "fallen", F.col("worst.name").alias("steepest"), F.col("worst.change_pct").alias("steepest_change_pct"),
        F.when(F.col("previous_week").isNull(), "no events the week before, so nothing to set it against")
        .when(F.col("fallen") == 0, f"no figure lost {threshold:g} % or more").alias("reason"),
        provenance(star.snapshots, [FUNNEL, ORDERS], ["dim_date"],
                   f"figures of a week that lost {threshold:g} % or more of what they were seven days earlier, counted",
                   start, F.date_add(start, 6), F.date_sub(start, 7), F.date_sub(start, 1), now=now))


def _threshold(value: float | None) -> float:
    return abs(float(ANOMALY_THRESHOLD if value is None else value))


def funnel_anomalies(star: Star, threshold_pct: float | None = None,
                     now: dt.datetime | None = None) -> DataFrame:
    """The latest complete week, steepest drop first; empty when nothing fell.

    ``anomaly_status`` says why the list is empty.
    """
    week = resolve_week(star)
    prior = week_containing(star, week.week_start_date - dt.timedelta(days=7))
    counts = _counts(star, [*week.date_keys, *prior.date_keys])
    return (_fallen(star, counts, _threshold(threshold_pct), now)
            .filter(F.col("current_week") == week.label).orderBy("change_pct", "kind", "name"))


def anomaly_status(star: Star) -> tuple[str | None, str | None, str | None]:
    """``(current week, previous week, reason)``; the reason is set if they cannot be compared."""
    try:
        week = resolve_week(star)
    except MetricError as error:
        return None, None, str(error)
    try:
        prior = week_containing(star, week.week_start_date - dt.timedelta(days=7))
    except MetricError as error:
        return week.label, None, str(error)
    seen = {r.iso_week for r in _counts(star, [*week.date_keys, *prior.date_keys])
            .select("iso_week").collect()}
    for w in (week, prior):
        if w.iso_week not in seen:
            return week.label, prior.label, f"no funnel events recorded for {w.label}"
    return week.label, prior.label, None

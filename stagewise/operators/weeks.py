"""Which week a question is about, always decided by the calendar table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.errors import MetricError
from stagewise.functions.calendar import week_label
from stagewise.operators.arguments import week_number
from stagewise.plans.daily import WEEK
from stagewise.star import Star


@dataclass(frozen=True)
class Week:
    """A resolved week and the keys of its days: a few literals, so that facts
    are filtered by constants that reach the scan."""

    iso_year: int
    iso_week: int
    week_start_date: dt.date
    date_keys: tuple[int, ...]

    @property
    def label(self) -> str:
        return f"{self.iso_year}-W{self.iso_week:02d}"

    @property
    def week_end(self) -> dt.date:
        return self.week_start_date + dt.timedelta(days=6)


def week_table(star: Star) -> DataFrame:
    """Weeks of the calendar with label, Monday-to-Sunday range, days held and day keys."""
    return (star.dim_date.groupBy(*WEEK)
            .agg(F.min("week_start_date").alias("week_start_date"),
                 F.max("date").alias("last_date"),
                 F.count(F.lit(1)).alias("days_observed"),
                 F.sort_array(F.collect_list("date_key")).alias("date_keys"))
            .withColumn("week", week_label(F.col("iso_year"), F.col("iso_week")))
            .withColumn("week_end", F.date_add("week_start_date", 6)))


def latest_complete_week(star: Star, basis: str = "calendar") -> DataFrame:
    """The newest week with all seven days in the calendar.

    A calendar may run past the facts.  ``basis="fact"`` also asks that the
    funnel fact reaches the end of the week.
    """
    weeks = week_table(star).filter(F.col("days_observed") == 7)
    if basis == "fact":
        seen = star.fact_funnel_event.select("date_key").distinct()
        held = star.dim_date.join(seen, "date_key", "left_semi")
        weeks = weeks.filter(F.col("last_date") <= held.agg(F.max("date")).scalar())
    elif basis != "calendar":
        raise MetricError(f"basis must be calendar or fact, got {basis!r}")
    return (weeks.orderBy(F.desc("iso_year"), F.desc("iso_week")).limit(1)
            .select(*WEEK, "week", "week_start_date", "week_end", "date_keys"))


def _first_week(frame: DataFrame, otherwise: str) -> Week:
    row = frame.select(*WEEK, "week_start_date", "date_keys").first()
    if row is None:
        raise MetricError(otherwise)
    return Week(row.iso_year, row.iso_week, row.week_start_date, tuple(row.date_keys))


def resolve_week(star: Star, iso_year: int | None = None, iso_week: int | None = None,
                 basis: str = "calendar") -> Week:
    """An explicit week, or the latest complete one.  Reads only the calendar."""
    if iso_year is None or iso_week is None:
        return _first_week(latest_complete_week(star, basis),
                           "the calendar holds no complete ISO week")
    number = week_number(iso_week)
    found = week_table(star).filter(
        (F.col("iso_year") == int(iso_year)) & (F.col("iso_week") == number))
    return _first_week(found, f"{int(iso_year)}-W{number:02d} is outside the calendar")


def week_containing(star: Star, day: dt.date) -> Week:
    inside = star.dim_date.filter(F.col("date") == F.lit(day)).select(*WEEK)
    found = week_table(star).join(inside, list(WEEK), "left_semi")
    return _first_week(found, f"{day.isoformat()} is outside the calendar")


def resolve_weeks(star: Star, requests: DataFrame) -> DataFrame:
    """Bulk form: ``requests(iso_year, iso_week)`` with what the calendar knows of them."""
    known = week_table(star).select(*WEEK, "week_start_date", "week_end")
    number = F.col("iso_week")
    return (requests.join(known, list(WEEK), "left")
            .withColumn("week", week_label(F.col("iso_year"), number))
            .withColumn("note", F.when(~number.between(1, 53), "iso_week must be 1-53")
                        .when(F.col("week_start_date").isNull(), "outside the calendar")))


def weeks_containing(star: Star, days: DataFrame) -> DataFrame:
    """Bulk form: ``days(date)`` with the week the calendar puts each in, null if none."""
    known = star.dim_date.select("date", *WEEK, "week_start_date")
    return (days.join(known, "date", "left")
            .withColumn("week", F.when(F.col("iso_week").isNotNull(),
                                       week_label(F.col("iso_year"), F.col("iso_week")))))

"""Calendar attributes, period labels and period text.

Weeks are keyed by ``(iso_year, iso_week)``; months, quarters and years follow
the civil calendar.  The two disagree around New Year, so they never mix.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.schemas import DIM_DATE

GRAINS = ("week", "month", "quarter", "year")


def date_row(key: Column, day: Column) -> list[Column]:
    """The columns of one calendar row."""
    return [
        key.cast("int").alias("date_key"),
        day.alias("date"),
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"),
        F.weekofyear(day).alias("iso_week"),
        F.to_date(F.date_trunc("week", day)).alias("week_start_date"),
        F.date_format(day, "EEEE").alias("day_of_week"),
    ]


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day of a closed span; the key is the position in the span."""
    days = spark.range(0, (last - first).days + 1, 1, 1)  # some 365 rows a year: no task has less to do
    start = F.lit(first).cast("date")
    day = F.date_add(start, F.col("id").cast("int"))
    return days.select("id", day.alias("day")).select(*date_row(F.col("id"), F.col("day")))


def calendar_of(times: DataFrame) -> DataFrame:
    """One row per day between the first and the last moment of a one-column frame."""
    moment = F.col(times.columns[0])
    span = times.agg(F.to_date(F.min(moment)).alias("lo"), F.to_date(F.max(moment)).alias("hi"))
    days = span.filter("lo IS NOT NULL").select(F.posexplode(F.sequence("lo", "hi")).alias("id", "day"))
    return days.select(*date_row(F.col("id"), F.col("day")))


def extend_calendar(existing: DataFrame, days: DataFrame) -> DataFrame:
    """Add the dates of ``days`` that are missing.

    Rows already there keep their keys; new dates continue from the highest key
    in date order.  The numbering window sees only missing days, so its size is
    bounded by the calendar and not by any fact.
    """
    highest = F.coalesce(existing.agg(F.max("date_key").alias("k")).scalar(), F.lit(-1))
    missing = (days.select("date").distinct()
               .join(existing.select("date"), "date", "left_anti"))
    numbered = missing.withColumn("n", F.row_number().over(Window.orderBy("date")))
    added = numbered.select(*date_row(F.col("n") + highest, F.col("date")))
    return existing.select(*DIM_DATE.fieldNames()).unionByName(added)


def period_label(grain: str) -> Column:
    """The name of the period a calendar row falls in: 2026-W03, 2026-03, 2026-Q1, 2026."""
    if grain == "week":
        return week_label(F.col("iso_year"), F.col("iso_week"))
    if grain == "month":
        return F.format_string("%d-%02d", F.col("year"), F.col("month"))
    if grain == "quarter":
        return F.format_string("%d-Q%d", F.col("year"), F.col("quarter"))
    if grain == "year":
        return F.format_string("%d", F.col("year"))
    raise ValueError(f"unknown grain {grain!r}")


def week_label(iso_year: Column, iso_week: Column) -> Column:
    return F.format_string("%d-W%02d", iso_year, iso_week)


def period_length(grain: str, start: Column) -> Column:
    """Days a whole period has, whatever part of it the calendar table holds."""
    if grain == "week":
        return F.lit(7)
    step = {"month": 1, "quarter": 3, "year": 12}[grain]
    first = F.to_date(F.date_trunc(grain, start))
    return F.datediff(F.add_months(first, step), first)


# The letter that names a grain's part, the canonical form, and the largest number of digits of the part.
_PARTS = {"week": ("W", "%s-W%02d", 2), "month": ("", "%s-%02d", 2), "quarter": ("Q", "%s-Q%d", 1)}


def normalise_period(text: Column, grain: str) -> Column:
    """``2026-3``, ``q1 2026``, ``2026-w5`` as the period label they mean.

    The text is taken apart into numbers and one letter, and these are checked against what
    the grain is made of.  A quarter may come before its year.  Text in no known form comes
    back in upper case, words joined by hyphens, so that it can be named as unknown.
    """
    shown = F.regexp_replace(F.upper(F.trim(F.regexp_replace(text, r"\s", " "))), " ", "-")
    numbers = F.regexp_extract_all(shown, F.lit("[0-9]+"), 0)
    rest = F.regexp_replace(shown, "[0-9]+", "#")  # what stands between and around the numbers
    if grain == "year":
        return F.when((rest == "#") & (F.length(F.get(numbers, F.lit(0))) == 4), F.get(numbers, F.lit(0))).otherwise(shown)
    if grain not in _PARTS:
        return shown
    letter, form, digits = _PARTS[grain]
    after = rest.isin(*{f"#-{letter}#", f"#{letter}#"} - {"##"})
    before = rest == f"{letter}#-#" if grain == "quarter" else F.lit(False)
    year, part = F.when(before, F.get(numbers, F.lit(1))).otherwise(F.get(numbers, F.lit(0))), F.when(before, F.get(numbers, F.lit(0))).otherwise(F.get(numbers, F.lit(1)))
    fits = (after | before) & (F.length(year) == 4) & F.length(part).between(1, digits)
    return F.when(fits, F.format_string(form, year, part.try_cast("int"))).otherwise(shown)

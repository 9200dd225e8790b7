import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewise.errors import MetricError
from stagewise.functions.calendar import (calendar, extend_calendar, normalise_period,
                                          period_label, period_length)
from stagewise.operators import checks, weeks
from tests.conftest import day


def test_every_row_agrees_with_the_iso_calendar(spark):
    rows = calendar(spark, day("2021-01-01"), day("2027-12-31")).collect()
    assert len(rows) == 2556
    for key, r in enumerate(sorted(rows, key=lambda r: r.date)):
        iso = r.date.isocalendar()
        assert r.date_key == key
        assert (r.iso_year, r.iso_week) == (iso.year, iso.week)
        assert r.week_start_date == r.date - dt.timedelta(days=iso.weekday - 1)
        assert (r.year, r.month, r.quarter) == (r.date.year, r.date.month, (r.date.month + 2) // 3)
        assert (r.month_name, r.day_of_week) == (r.date.strftime("%B"), r.date.strftime("%A"))


@pytest.mark.parametrize("date, label", [
    ("2022-01-01", "2021-W52"), ("2024-12-30", "2025-W01"), ("2026-12-31", "2026-W53")])
def test_year_edges_belong_to_the_iso_year(spark, date, label):
    row = calendar(spark, day(date), day(date)).select(period_label("week").alias("w")).first()
    assert row.w == label


def test_labels(spark):
    frame = calendar(spark, day("2026-01-15"), day("2026-01-15"))
    row = frame.select(*[period_label(g).alias(g) for g in ("week", "month", "quarter", "year")]).first()
    assert tuple(row) == ("2026-W03", "2026-01", "2026-Q1", "2026")


def test_extension_keeps_old_keys_and_continues_from_the_highest(spark):
    old = calendar(spark, day("2025-12-28"), day("2025-12-31"))
    new = calendar(spark, day("2025-12-30"), day("2026-01-03"))
    rows = {r.date: r.date_key for r in extend_calendar(old, new).collect()}
    assert rows == {day("2025-12-28"): 0, day("2025-12-29"): 1, day("2025-12-30"): 2,
                    day("2025-12-31"): 3, day("2026-01-01"): 4, day("2026-01-02"): 5,
                    day("2026-01-03"): 6}


def test_extending_nothing_starts_at_zero(spark):
    days = calendar(spark, day("2026-01-01"), day("2026-01-02"))
    rows = extend_calendar(days.limit(0), days).orderBy("date").collect()
    assert [r.date_key for r in rows] == [0, 1]


@pytest.mark.parametrize("text, grain, want", [
    ("2026-3", "month", "2026-03"), ("2026-03", "month", "2026-03"),
    ("q1 2026", "quarter", "2026-Q1"), ("2026-Q1", "quarter", "2026-Q1"),
    ("2026q4", "quarter", "2026-Q4"), ("2026-w5", "week", "2026-W05"),
    (" 2026W12\t", "week", "2026-W12"), ("2026", "year", "2026"),
    ("march 2026", "month", "MARCH-2026"), ("2026-03", "year", "2026-03")])
def test_period_text(spark, text, grain, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(normalise_period(F.col("t"), grain)).first()[0] == want


def test_whole_period_lengths(spark):
    frame = spark.createDataFrame([(day("2024-02-10"),)], "d date")
    got = frame.select(*[period_length(g, F.col("d")) for g in ("week", "month", "quarter", "year")]).first()
    assert tuple(got) == (7, 29, 91, 366)


def test_no_week_spans_more_than_six_days(star_of):
    star = star_of("2021-01-01", "2027-12-31")
    row = checks.iso_week_span(star).first()
    assert row.rows_checked == 366 and row.violations == 0
    assert checks.widest_week(star).first().span_days == 6


def test_a_calendar_year_key_would_be_caught(star_of):
    star = star_of("2021-01-01", "2023-12-31")
    wrong = star.with_tables(dim_date=star.dim_date.withColumn("iso_year", F.col("year")))
    assert checks.iso_week_span(wrong).first().violations > 0
    assert checks.widest_week(wrong).first().span_days > 300


def test_latest_complete_week(star_of):
    star = star_of("2026-01-01", "2026-01-20", events=[("2026-01-06", "visit", 1)])
    assert weeks.resolve_week(star).label == "2026-W03"
    assert weeks.latest_complete_week(star, "fact").collect() == []
    longer = star_of("2026-01-01", "2026-01-20", events=[("2026-01-11", "visit", 1)])
    assert weeks.resolve_week(longer, basis="fact").label == "2026-W02"


def test_weeks_outside_the_calendar_are_errors(star_of):
    star = star_of("2026-01-01", "2026-01-20")
    week = weeks.resolve_week(star, 2026, 1)
    assert (week.week_start_date, week.week_end) == (day("2025-12-29"), day("2026-01-04"))
    assert week.date_keys == (0, 1, 2, 3)
    with pytest.raises(MetricError, match="1-53"):
        weeks.resolve_week(star, 2026, 54)
    with pytest.raises(MetricError, match="2026-W09"):
        weeks.resolve_week(star, 2026, 9)
    with pytest.raises(MetricError, match="2027-01-01"):
        weeks.week_containing(star, day("2027-01-01"))
    assert weeks.week_containing(star, day("2026-01-07")).label == "2026-W02"
    with pytest.raises(MetricError, match="complete"):
        weeks.resolve_week(star_of("2026-01-01", "2026-01-03"))


def test_bulk_week_resolution(spark, star_of):
    star = star_of("2026-01-01", "2026-01-20")
    asked = spark.createDataFrame([(2026, 2), (2026, 40), (2026, 60)], "iso_year int, iso_week int")
    got = {r.iso_week: (r.week_start_date, r.note) for r in weeks.resolve_weeks(star, asked).collect()}
    assert got == {2: (day("2026-01-05"), None), 40: (None, "outside the calendar"),
                   60: (None, "iso_week must be 1-53")}

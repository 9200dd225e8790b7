"""One measure in two calendar periods of the same grain.

Everything past the daily aggregate runs on calendar rows: periods, their order
and the span the fact covers are found with windows over the joined calendar, so
the fact is read once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.calendar import GRAINS, normalise_period, period_label, period_length
from stagewise.functions.ratios import change, direction, half_up
from stagewise.operators.arguments import grain_name, measure_name
from stagewise.operators.measures import daily, source_of, value_of
from stagewise.operators.provenance import provenance
from stagewise.star import Star

_PARTS = ("period", "start", "end", "value", "complete")


def periods(star: Star, measure: str, grain: str, strict: bool = False) -> DataFrame:
    """Every period of the calendar with its value.

    A period is complete when it lies inside the days the fact covers.  A
    complete period without rows is a real zero; any other is unknown.
    ``strict`` also asks that the calendar holds all days of the period.
    """
    measure, grain = measure_name(measure), grain_name(grain)
    held = daily(star, measure).select("date", "n", "amount")
    days = star.dim_date.withColumn("period", period_label(grain)).join(held, "date", "left")
    fact_day = F.when(F.col("n").isNotNull(), F.col("date"))
    per_period = days.groupBy("period").agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.count(F.lit(1)).alias("days"),
        F.min(fact_day).alias("fact_first"), F.max(fact_day).alias("fact_last"),
        value_of(measure, F.sum("n"), F.sum("amount")).alias("value"))
    everything = Window.partitionBy()  # one row per calendar period
    covered = ((F.col("start") >= F.min("fact_first").over(everything))
               & (F.col("end") <= F.max("fact_last").over(everything)))
    if strict:
        covered = covered & (F.col("days") == period_length(grain, F.col("start")))
    return (per_period.withColumn("complete", F.coalesce(covered, F.lit(False)))
            .withColumn("value", F.when(F.col("complete"), F.coalesce("value", F.lit(0.0)))
                        .otherwise(F.col("value")))
            .select(*_PARTS))


def _pairs(frame: DataFrame) -> DataFrame:
    """Each period with the one before it in ``frame``."""
    whole = F.struct(*_PARTS)
    return frame.select(whole.alias("current"),
                        F.lag(whole).over(Window.orderBy("start")).alias("previous"))


def _note() -> Column:
    names = [F.when(~F.col(f"{p}.complete"), F.col(f"{p}.period")) for p in ("current", "previous")]
    partial = F.concat_ws(", ", *names)
    base = F.col("previous.value")
    return (F.when(partial != "", F.concat(F.lit("incomplete in the data: "), partial, F.lit(
                "; totals of such periods are partial and their change means little")))
            .when(base.isNull() | (base == 0), F.concat(F.lit("no change can be given: "), F.col("previous.period"),
                                                        F.lit(" has nothing of this measure"))))


def _compared(star: Star, pairs: DataFrame, measure: str, grain: str | Column,
              now: dt.datetime | None) -> DataFrame:
    grain = F.lit(grain) if isinstance(grain, str) else grain
    current, previous = F.col("current.value"), F.col("previous.value")
    pct = change(current, previous)
    flat = [F.col(f"{side}.{part}").alias(f"{side}_{part}" if part != "period" else side)
            for side in ("current", "previous") for part in _PARTS]
    return pairs.filter(F.col("previous").isNotNull()).select(
        F.lit(measure).alias("measure"), grain.alias("grain"), *flat,
        half_up(current - previous, 2).alias("delta"),
        pct.alias("pct_change"), direction(pct).alias("direction"), _note().alias("note"),
        provenance(star.snapshots, [source_of(measure)], ["dim_date"],
                   F.concat(F.lit(f"{measure} per "), grain, F.lit("; pct_change = 100 * (current - previous) / previous")),
                   F.col("current.start"), F.col("current.end"),
                   F.col("previous.start"), F.col("previous.end"), now=now))


def periods_all(star: Star, measure: str, strict: bool = False) -> DataFrame:
    """``periods`` of all grains at once, with their ``grain``: the days are grouped by each grain in one pass."""
    measure = measure_name(measure)
    held = daily(star, measure).select("date", "n", "amount")
    days = (star.dim_date.withColumns({g: period_label(g) for g in GRAINS}).join(held, "date", "left")
            .select("date", "n", "amount", *GRAINS))
    fact_day = F.when(F.col("n").isNotNull(), F.col("date"))
    per_period = days.groupingSets([[F.col(g)] for g in GRAINS], *GRAINS).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"),
        F.min(fact_day).alias("fact_first"), F.max(fact_day).alias("fact_last"),
        value_of(measure, F.sum("n"), F.sum("amount")).alias("value"))
    named = per_period.select("*", F.coalesce(*[F.when(F.col(g).isNotNull(), g) for g in GRAINS]).alias("grain"),
                              F.coalesce(*GRAINS).alias("period"))
    everything = Window.partitionBy("grain")  # one row per calendar period
    covered = ((F.col("start") >= F.min("fact_first").over(everything))
               & (F.col("end") <= F.max("fact_last").over(everything)))
    if strict:
        full = F.coalesce(*[F.when(F.col("grain") == g, period_length(g, F.col("start"))) for g in GRAINS])
        covered = covered & (F.col("days") == full)
    return (named.withColumn("complete", F.coalesce(covered, F.lit(False)))
            .withColumn("value", F.when(F.col("complete"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
            .select("grain", *_PARTS))


def period_changes_all(star: Star, measure: str = "revenue", strict: bool = False,
                       now: dt.datetime | None = None) -> DataFrame:
    """Every period of every grain against the calendar period before it, from one read of the fact."""
    measure = measure_name(measure)
    whole = F.struct(*_PARTS)
    pairs = periods_all(star, measure, strict).select(
        "grain", whole.alias("current"), F.lag(whole).over(Window.partitionBy("grain").orderBy("start")).alias("previous"))
    return _compared(star, pairs, measure, F.col("grain"), now)


def period_changes(star: Star, measure: str = "revenue", grain: str = "month",
                   strict: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """Every period against the calendar period before it."""
    measure, grain = measure_name(measure), grain_name(grain)
    return _compared(star, _pairs(periods(star, measure, grain, strict)), measure, grain, now)


def period_compare(star: Star, measure: str = "revenue", grain: str = "month",
                   current: str | None = None, previous: str | None = None,
                   strict: bool = False, now: dt.datetime | None = None) -> DataFrame:
    """Two periods named as ``2026-03``, ``2026-Q1``, ``2026-W12`` or ``2026``.

    Without ``current`` the two newest complete periods are compared, whatever
    ``previous`` says; with it alone, the period before it on the calendar.  An
    unknown period gives no row; ``unknown_period`` words the reason.
    """
    measure, grain = measure_name(measure), grain_name(grain)
    frame = periods(star, measure, grain, strict)
    if current is None:
        pairs = (_pairs(frame.filter("complete"))
                 .orderBy(F.desc("current.start")).limit(1))
    elif previous is None:
        pairs = _pairs(frame).filter(F.col("current.period") == _canonical(current, grain))
    else:
        whole = F.struct(*_PARTS)
        is_current = F.col("period") == _canonical(current, grain)
        is_previous = F.col("period") == _canonical(previous, grain)
        pairs = (frame.filter(is_current | is_previous)
                 .agg(F.max(F.when(is_current, whole)).alias("current"),
                      F.max(F.when(is_previous, whole)).alias("previous"))
                 .filter(F.col("current").isNotNull()))
    return _compared(star, pairs, measure, grain, now)


def _canonical(text: str, grain: str) -> Column:
    return normalise_period(F.lit(str(text)), grain)


def compare_requests(star: Star, requests: DataFrame, measure: str, grain: str,
                     now: dt.datetime | None = None) -> DataFrame:
    """Bulk form: every row of ``requests(request, current, previous)`` as text in any known spelling.

    No request is lost: one with an unknown period keeps its row, and ``note`` says which side.
    """
    measure, grain = measure_name(measure), grain_name(grain)
    frame = periods(star, measure, grain)
    asked = requests.select("request", *[normalise_period(F.col(s), grain).alias(f"{s}_key") for s in ("current", "previous")])
    distinct = asked.select("current_key", "previous_key").distinct()
    sides = [frame.select(F.col("period").alias(f"{s}_key"), F.struct(*_PARTS).alias(s)) for s in ("current", "previous")]
    pairs = (distinct.join(sides[0], "current_key").join(sides[1], "previous_key"))
    found = _compared(star, pairs, measure, grain, now)
    known = frame.select("period")
    asked = (asked.join(known.select(F.col("period").alias("current_key"), F.lit(True).alias("has_current")), "current_key", "left")
             .join(known.select(F.col("period").alias("previous_key"), F.lit(True).alias("has_previous")), "previous_key", "left"))
    lost = F.concat_ws("; ", *[F.when(F.col(f"has_{s}").isNull(), F.concat(F.lit(f"unknown {s} {grain}: "), F.coalesce(f"{s}_key", F.lit("none"))))
                               for s in ("current", "previous")])
    rest = [c for c in found.columns if c not in ("current", "previous", "note", "measure", "grain")]
    return (asked.join(found.drop("measure", "grain"), (asked["current_key"] == found["current"]) & (asked["previous_key"] == found["previous"]), "left")
            .select("request", F.lit(measure).alias("measure"), F.lit(grain).alias("grain"), F.col("current_key").alias("current"),
                    F.col("previous_key").alias("previous"), *rest, F.coalesce(F.when(lost != "", lost), "note").alias("note")))


def why_not_compared(star: Star, measure: str, grain: str, current: str | None = None,
                     previous: str | None = None, named: int = 8) -> str:
    """Why ``period_compare`` has no row; at most ``named`` known periods are listed."""
    measure, grain = measure_name(measure), grain_name(grain)
    frame = periods(star, measure, grain)
    held = frame.agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("whole"), F.min_by("period", "start").alias("first"),
                     F.max_by("period", "start").alias("last")).first()
    if not held.n:
        return f"the calendar holds no {grain}"
    span = f"{held.n} known, {held.first} to {held.last}"
    if current is None:
        newest = [r.period for r in frame.filter("complete").orderBy(F.desc("start")).limit(named).collect()]
        return (f"two complete {grain}s of {measure} are needed and {held.whole} found"
                + (f": {', '.join(reversed(newest))}" if newest else "") + f" ({span})")
    names = {side: frame.select(_canonical(text, grain).alias("p")).first().p
             for side, text in (("current", current), ("previous", previous)) if text is not None}
    known = {r.period for r in frame.filter(F.col("period").isin(*names.values())).select("period").collect()}
    for side, name in names.items():
        if name not in known:
            return f"{side} {grain} {name} is unknown ({span})"
    if previous is None and names["current"] == held.first:
        return f"{held.first} is the earliest {grain}, nothing comes before it"
    return f"no row for {names} ({span})"

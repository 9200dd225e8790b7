"""Guarded percentages.  An undefined ratio is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """A double rounded half up in decimal.

    The tenth decimal absorbs binary noise first, so that a quotient that is a
    tie on paper is treated as one.
    """
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def _percent(part: Column, whole: Column, digits: int) -> Column:
    whole = whole.cast("double")
    return half_up(F.lit(100.0) * part / F.nullif(whole, F.lit(0.0)), digits)


def share(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, two decimals."""
    return _percent(part.cast("double"), whole, 2)


def change(current: Column, baseline: Column) -> Column:
    """Relative change from ``baseline`` to ``current`` in percent, one decimal."""
    return _percent(current.cast("double") - baseline.cast("double"), baseline, 1)


def direction(pct: Column) -> Column:
    return (F.when(pct.isNull(), "unknown").when(pct > 0, "up")
            .when(pct < 0, "down").otherwise("flat"))

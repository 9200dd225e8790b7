"""As-of join by sort and carry: for every moment the newest change at or before it.

Moments and changes are laid on one line, cut into slices of about as many rows each, and sorted
inside a slice; a moment takes the change before it, or, where its slice has none, the one carried
over from the slices before.  So the rows made are the moments asked and the changes held, however
many changes fall on one day or one second.  Equal moments are asked once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows are sorted together.
SLICE_ROWS = 2_000_000
#: The line is cut into so many slices at most; beyond that they grow.
SLICES = 1000
_T, _KIND, _TIE, _HELD, _SLICE = ("asof_t", "asof_kind", "asof_tie", "asof_held", "asof_slice")


def cuts(line: DataFrame, slices: int) -> list[int]:
    """Times between slices of about as many rows each."""
    if slices < 2:
        return []
    at = [i / slices for i in range(1, slices)]
    found = line.agg(F.percentile_approx(_T, at, 100 * slices).alias("p")).first().p
    return sorted(set(found or []))


def slice_of(t: Column, bounds: Sequence[int]) -> Column:
    """How many of the bounds a time has reached."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= t))


def as_of_join(asked: DataFrame, changes: DataFrame, at: str, since: str, values: Sequence[str], tie: str,
               by: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """``asked`` with the ``values`` of the newest row of ``changes`` whose ``since`` is not after ``at``.

    ``by`` names columns that both must agree on; of changes at one time the largest ``tie`` is the
    newest.  Values are null where there is no such change or no moment.
    """
    by = list(by)
    moments = (asked.filter(F.col(at).isNotNull()).select(*by, F.unix_micros(F.col(at).cast("timestamp")).alias(_T)).distinct()
               .select(*by, _T, F.lit(1).alias(_KIND), F.lit(None).cast(changes.schema[tie].dataType).alias(_TIE)))
    held = changes.filter(F.col(since).isNotNull()).select(
        *by, F.unix_micros(F.col(since).cast("timestamp")).alias(_T), F.lit(0).alias(_KIND), F.col(tie).alias(_TIE),
        F.struct(*values).alias(_HELD))
    line = held.unionByName(moments, allowMissingColumns=True)
    if slices is None:
        slices = min(SLICES, -(-line.count() // SLICE_ROWS))
    bounds = cuts(line, slices)
    line = line.withColumn(_SLICE, slice_of(F.col(_T), bounds))
    # of each slice with a row the last change, carried on to the next ones: a row per slice
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (line.groupBy(*by, _SLICE).agg(F.max_by(_HELD, F.when(F.col(_KIND) == 0, F.struct(_T, _TIE))).alias("asof_last"))
               .select(*by, _SLICE, F.last("asof_last", ignorenulls=True).over(earlier).alias("asof_carried")))
    order = Window.partitionBy(*by, _SLICE).orderBy(_T, _KIND, _TIE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (line.withColumn(_HELD, F.last(_HELD, ignorenulls=True).over(order)).filter(F.col(_KIND) == 1))
    if bounds:
        same = F.lit(True)
        for c in by:
            same = same & carried[c].eqNullSafe(found[c])
        found = (found.join(carried, same & (found[_SLICE] == carried[_SLICE]), "left")
                 .select(*[found[c] for c in by], found[_T], F.coalesce(found[_HELD], carried["asof_carried"]).alias(_HELD)))
    found = found.select(*[F.col(c).alias(f"asof_{c}") for c in by], _T, _HELD)
    match = F.unix_micros(asked[at].cast("timestamp")) == found[_T]
    for c in by:
        match = match & asked[c].eqNullSafe(found[f"asof_{c}"])
    return asked.join(found, match, "left").select(*[asked[c] for c in asked.columns], *[F.col(f"{_HELD}.{v}").alias(v) for v in values])

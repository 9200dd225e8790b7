"""Ask one metric by name and get plain rows, with the checks every answer passes.

The functions in ``stagewise.operators`` stay lazy; this is the small step that
runs one of them, refuses an answer without provenance and turns an empty answer
into an error that says why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stagewise.errors import MetricError
from stagewise.operators import funnel, history, periods, rank, trends
from stagewise.operators.provenance import require_provenance
from stagewise.sources.ledger import Ledger
from stagewise.star import Star

ON_STAR: dict[str, Callable[..., DataFrame]] = {
    "funnel_yoy": funnel.funnel_yoy,
    "funnel_snapshot": funnel.funnel_snapshot,
    "funnel_anomalies": funnel.funnel_anomalies,
    "weekly_trend": trends.weekly_trend,
    "running_total": trends.running_total,
    "running_total_latest": trends.running_total_latest,
    "daily_trend": trends.daily_trend_summary,
    "daily_trend_points": trends.daily_trend,
    "top_dimension": rank.top_dimension,
    "period_compare": periods.period_compare,
}
ON_LEDGER: dict[str, Callable[..., DataFrame]] = {
    "compare_as_of": history.compare_as_of,
    "snapshot_history": history.snapshot_history,
}
# an empty list is itself the answer of these
MAY_BE_EMPTY = ("funnel_anomalies", "weekly_trend")
METRICS = (*ON_STAR, *ON_LEDGER)


def frame(metric: str, star: Star, ledger: Ledger | None = None, **arguments) -> DataFrame:
    """The lazy answer of a metric, checked for provenance."""
    if metric in ON_STAR:
        return require_provenance(ON_STAR[metric](star, **arguments))
    if metric not in METRICS:
        raise MetricError(f"unknown metric {metric!r}; use one of {', '.join(METRICS)}")
    if ledger is None:
        raise MetricError(f"{metric} needs versioned tables")
    return require_provenance(ON_LEDGER[metric](ledger, **arguments))


def answer(metric: str, star: Star, ledger: Ledger | None = None, **arguments) -> list[dict]:
    """The rows of a metric.

    Answers are bounded by the calendar and their arguments; the audit trail has one
    row per commit.
    """
    rows = [r.asDict(recursive=True) for r in frame(metric, star, ledger, **arguments).collect()]
    if rows or metric in MAY_BE_EMPTY:
        return rows
    if metric == "period_compare":
        raise MetricError(periods.why_not_compared(
            star, arguments.get("measure", "revenue"), arguments.get("grain", "month"),
            arguments.get("current"), arguments.get("previous")))
    asked = ", ".join(f"{k}={v}" for k, v in arguments.items()) or "its defaults"
    raise MetricError(f"no data for {metric} with {asked}")


__all__ = ["METRICS", "answer", "frame"]

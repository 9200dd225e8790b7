"""Checks on arguments, made before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from stagewise.errors import MetricError
from stagewise.functions.calendar import GRAINS
from stagewise.schemas import STAGES

MEASURES = (*STAGES, "orders", "revenue", "avg_deal_size")


def _one_of(kind: str, value: str, allowed: Iterable[str]) -> str:
    if value not in allowed:
        raise MetricError(f"unknown {kind} {value!r}; use one of {', '.join(allowed)}")
    return value


def stage_name(value: str | None) -> str:
    return _one_of("funnel stage", (value or "").strip().lower(), STAGES)


def measure_name(value: str, without: str | None = None) -> str:
    return _one_of("measure", value, [m for m in MEASURES if m != without])


def grain_name(value: str | None) -> str:
    return _one_of("grain", (value or "month").strip().lower(), GRAINS)


def how_many(kind: str, value: int) -> int:
    """A number of rows asked for: as many as there are may be asked for, but not none."""
    if int(value) < 1:
        raise MetricError(f"{kind} must be 1 or more, got {value}")
    return int(value)


def week_number(value: int) -> int:
    if not 1 <= int(value) <= 53:
        raise MetricError(f"iso_week must be 1-53, got {value}")
    return int(value)

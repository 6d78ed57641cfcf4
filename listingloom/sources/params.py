"""Run parameters. ``as_of`` is always given, so a run can be repeated exactly."""

from __future__ import annotations

from dataclasses import dataclass

from listingloom.schema import (
    DAYS_BACK_RANGE,
    DEFAULT_DAYS_BACK,
    DEFAULT_INTERVAL_HOURS,
    INTERVAL_HOURS_RANGE,
)

DAY = 86_400


@dataclass(frozen=True)
class RunParams:
    as_of: int
    start: int
    interval_hours: float = DEFAULT_INTERVAL_HOURS


def checked_interval(hours: float) -> float:
    low, high = INTERVAL_HOURS_RANGE
    if not low <= hours <= high:
        raise ValueError(f"interval must be {low} to {high} hours, got {hours}")
    return hours


def run_params(
    as_of: int,
    start: int | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    interval_hours: float = DEFAULT_INTERVAL_HOURS,
) -> RunParams:
    """A stored ``start`` is absolute; otherwise the window rolls with ``as_of``."""
    low, high = DAYS_BACK_RANGE
    if not low <= days_back <= high:
        raise ValueError(f"days_back must be {low} to {high}, got {days_back}")
    if start is not None and start <= 0:
        raise ValueError(f"start must be greater than 0, got {start}")
    checked_interval(interval_hours)
    return RunParams(as_of, as_of - days_back * DAY if start is None else start, interval_hours)

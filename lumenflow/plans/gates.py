"""Checks made while planning: input gates, slice bounds, configuration."""

from __future__ import annotations

import re

_TIME = re.compile(r"^(?:(\d{1,2}):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$")


def parse_time(value: str | float) -> float:
    """Seconds of raw seconds, MM:SS(.f) or HH:MM:SS(.f); ValueError for anything else."""
    try:
        seconds = float(value)
    except ValueError:
        if not (m := _TIME.match(str(value))):
            raise ValueError(f"not a time: {value!r}") from None
        seconds = int(m[1] or 0) * 3600 + int(m[2]) * 60 + float(m[3])
    if seconds < 0:
        raise ValueError(f"a time must not be negative: {value!r}")
    return seconds


def slice_bounds(start: str | None, end: str | None, duration: float) -> tuple[float, float]:
    """[start, end) within the duration; an end beyond it is clipped, a start beyond it or after the end is an error."""
    lo = parse_time(start) if start is not None else 0.0
    hi = parse_time(end) if end is not None else duration
    if lo >= duration:
        raise ValueError("the slice starts after the end")
    if lo >= hi:
        raise ValueError("the slice ends before it starts")
    return lo, min(hi, duration)


def require(available: set[str], *needed: str) -> None:
    """Raise, naming what is missing, unless all inputs of an operator are there."""
    if missing := [n for n in needed if n not in available]:
        raise ValueError("skipped: missing " + ", ".join(missing))

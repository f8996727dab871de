"""Interval texts such as '5 minutes' or '1h30m'."""

from __future__ import annotations

import re

from rivulet.errors import ParseError

#: Microseconds of each unit.
UNITS = {
    "microsecond": 1, "us": 1, "millisecond": 1_000, "ms": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000,
    "m": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000, "week": 604_800_000_000, "w": 604_800_000_000,
}
_PART = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)")


def micros(text: str) -> int:
    """Length in microseconds; a bare number is seconds. Raises ParseError for anything else."""
    at, total, text = 0, 0.0, text.strip()
    if not text:
        raise ParseError("empty interval")
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ParseError(f"bad interval {text!r}")
        unit = m[2].lower() or "s"
        size = UNITS.get(unit) or UNITS.get(unit.removesuffix("s"))
        if size is None:
            raise ParseError(f"unknown unit {m[2]!r} in interval {text!r}")
        total += float(m[1]) * size
        at = m.end()
    return round(total)


def spark_interval(text: str) -> str:
    """The same length as Spark writes it, for window() and withWatermark()."""
    us = micros(text)
    if us <= 0:
        raise ParseError(f"interval {text!r} is not positive")
    return f"{us // 1_000_000} seconds" if us % 1_000_000 == 0 else f"{us} microseconds"

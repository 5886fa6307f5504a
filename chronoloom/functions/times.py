"""Slots, durations and request times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01 to 1970-01-01: slots are aligned to the former (fixed value).
EPOCH_SHIFT = 11_644_473_600
#: Seconds of each unit of a duration (fixed values).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}


def align(t: Column, step: Column | int) -> Column:
    """Start of the slot of ``step`` seconds that holds ``t``."""
    shifted = t + F.lit(EPOCH_SHIFT)
    return t - F.pmod(shifted, F.lit(step) if isinstance(step, int) else step)


def duration(text: str) -> int:
    """``[+-]N<unit>`` in seconds; a number alone counts seconds."""
    m = re.fullmatch(r"\s*([+-]?)(\d+(?:\.\d+)?)\s*([a-z]*)\s*", text)
    unit = m and (m[3] or "s")
    if unit and unit not in UNITS:
        unit = {"sec": "s", "min": "m", "hour": "h", "day": "d", "week": "w", "year": "y"}.get(re.sub(r"(ond|ute)?s?$", "", unit)) or {"seconds": "s", "minutes": "m"}.get(unit)
    if not unit:
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[2]) * UNITS[unit]) * (-1 if m[1] == "-" else 1)


def request_time(text: str | int | None, now: int) -> int:
    """Absolute seconds, ``now``, or a signed duration from now; none means now."""
    if text is None or text in ("", "now"):
        return now
    if isinstance(text, int) or re.fullmatch(r"\d+", text):
        return int(text)
    return now + duration(text)

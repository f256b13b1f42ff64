"""Time codes, clock strings and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_smpte(seconds: Column, fps: int = 24) -> Column:
    """``HH:MM:SS:FF``; a missing time is 0."""
    total = (F.coalesce(seconds, F.lit(0.0)) * fps).cast("long")
    whole = F.floor(total / fps)
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, total % fps,
    )


def smpte_to_seconds(smpte: Column, fps: int = 24) -> Column:
    """Inverse of :func:`seconds_to_smpte`; anything but four numbers is 0."""
    parts = F.transform(F.split(smpte, ":"), lambda p: F.trim(p).try_cast("long"))
    h, m, s, f = (F.get(parts, i) for i in range(4))
    value = h * 3600 + m * 60 + s + f / F.lit(fps)
    return F.when(F.size(parts) == 4, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def clock_to_seconds(line: Column) -> Column:
    """Seconds of a ``time=HH:MM:SS.ff`` mark in a log line, else 0."""
    pattern = r"time=(\d{2}):(\d{2}):(\d{2}\.\d+)"
    h, m, s = (F.regexp_extract(line, pattern, g).try_cast("double") for g in (1, 2, 3))
    return F.coalesce(h * 3600 + m * 60 + s, F.lit(0.0))


def parse_ratio(ratio: Column) -> Column:
    """``a:b`` or a plain number; 0 when it cannot be read or b is 0."""
    parts = F.split(ratio, ":")
    num, den = (F.trim(F.get(parts, i)).try_cast("long") for i in (0, 1))
    of_pair = F.when((F.size(parts) == 2) & (den != 0), num / den)
    value = F.when(F.contains(ratio, F.lit(":")), of_pair).otherwise(ratio.try_cast("double"))
    return F.coalesce(value, F.lit(0.0))

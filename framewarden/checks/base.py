"""Building blocks the checks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED, WARNING, REJECTED = "PASSED", "WARNING", "REJECTED"


def event(
    kind: str, details: Column | None = None, start: Column | None = None, end: Column | None = None,
    severity: Column | None = None,
) -> Column:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        F.lit(kind).alias("type"),
        (number if start is None else start).alias("start_time"),
        (number if end is None else end).alias("end_time"),
        (text if severity is None else severity).alias("severity"),
        (text if details is None else details).alias("details"),
    )


def list_events(df: DataFrame, *candidates: Column) -> DataFrame:
    """One row per candidate that is not null; a file has a fixed few."""
    found = F.array_compact(F.array(*candidates))
    return df.select("file_id", F.explode(found).alias("_e")).select("file_id", "_e.*")


def is_strict(mode: Column | str) -> Column:
    return (F.lit(mode) if isinstance(mode, str) else mode) == "strict"


def flags_by_file(files: DataFrame, events: DataFrame, **flags: Column) -> DataFrame:
    """``files`` with one true/false per flag: does any of its events satisfy it?"""
    seen = events.groupBy("file_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    joined = files.join(seen, "file_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(False)) for n in flags})

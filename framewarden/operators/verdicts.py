"""Worst-status roll-ups.  Three rankings exist and stay apart on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank of each status when modules are folded into a file verdict
# (any other word ranks 0) and when segment verdicts are folded.
MODULE_RANKS = {"CRASHED": 4, "REJECTED": 3, "CORRUPT": 3, "WARNING": 2, "PASSED": 1}
SEGMENT_RANKS = {"PASSED": 1, "WARNING": 2, "REJECTED": 3, "ERROR": 4}


def rank(status: Column, ranks: dict[str, int]) -> Column:
    out = None
    for word, value in ranks.items():
        out = F.when(status == word, value) if out is None else out.when(status == word, value)
    return out.otherwise(0)


def reported_status(default: str = "UNKNOWN") -> Column:
    """``effective_status`` before ``status``."""
    return F.coalesce("effective_status", "status", F.lit(default))


def _worst(status: Column, ranks: dict[str, int], floor: int, order: str) -> Column:
    """First status of the highest rank, PASSED unless above ``floor``.

    Words sharing a rank are told apart by where each occurs first, so all
    aggregates are numbers and combine in a hash table.
    """
    top = F.max(rank(status, ranks))
    out = None
    for value in sorted({v for v in ranks.values() if v > floor}, reverse=True):
        words = [w for w, v in ranks.items() if v == value]
        word = F.lit(words[0])
        if len(words) > 1:
            seen = [F.struct(F.min(F.when(status == w, F.col(order))).alias("at"), F.lit(w).alias("w")) for w in words]
            word = F.array_min(F.filter(F.array(*seen), lambda s: s["at"].isNotNull()))["w"]
        out = F.when(top == value, word) if out is None else out.when(top == value, word)
    return out.otherwise("PASSED")


def overall_status_of(order: str = "ord") -> Column:
    """The aggregate behind :func:`overall_status`."""
    return _worst(reported_status(), MODULE_RANKS, 0, order)


def overall_status(reports: DataFrame, keys: Sequence[str] = ("file_id",), order: str = "ord") -> DataFrame:
    """Verdict of a file: its worst module, the first one among equals."""
    return reports.groupBy(*keys).agg(overall_status_of(order).alias("overall_status"))


def segment_worst_status(segments: DataFrame, keys: Sequence[str] = ("file_id",), order: str = "ord") -> DataFrame:
    status = F.coalesce("status", F.lit("PASSED"))
    return segments.groupBy(*keys).agg(_worst(status, SEGMENT_RANKS, 1, order).alias("overall_status"))


def escalate(reports: DataFrame, keys: Sequence[str], status: Column | None = None) -> DataFrame:
    """Any REJECTED wins, then any WARNING; other words do not count."""
    s = F.col("status") if status is None else status
    return reports.groupBy(*keys).agg(
        F.when(F.coalesce(F.bool_or(s == "REJECTED"), F.lit(False)), "REJECTED")
        .when(F.coalesce(F.bool_or(s == "WARNING"), F.lit(False)), "WARNING")
        .otherwise("PASSED")
        .alias("status")
    )


def segment_summary(reports: DataFrame) -> DataFrame:
    """Segments per file with counts of rejected and warning reports.

    Segments are made distinct first, so a file's reports do not meet in one task.
    """
    per_segment = reports.groupBy("file_id", "segment_id").agg(
        F.count_if(F.col("status") == "REJECTED").alias("e"), F.count_if(F.col("status") == "WARNING").alias("w")
    )
    return per_segment.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_segments"), F.sum("e").alias("total_errors"), F.sum("w").alias("total_warnings")
    )


# What every report must carry, and the status words allowed.
REQUIRED_KEYS = ("module", "video_file", "status", "metrics", "events")
STATUS_WORDS = ("PASSED", "WARNING", "REJECTED", "ERROR")


def missing_keys(present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), present)


def contract_violations(reports: DataFrame) -> DataFrame:
    """First broken rule of each report, as rows.

    Needs ``present_keys`` (array), ``status`` and ``n_events``.
    """
    missing = missing_keys(F.col("present_keys"))
    known = F.coalesce(F.col("status").isin(*STATUS_WORDS), F.lit(False))
    broken = (
        F.when(F.size(missing) > 0, "missing_keys")
        .when(~known, "invalid_status")
        .when((F.col("status") != "PASSED") & (F.col("n_events") == 0), "no_events")
    )
    return reports.withColumns({"missing": missing, "violation": broken}).where(F.col("violation").isNotNull())


def crash_reports(files: DataFrame, reports: DataFrame, modules: Sequence[str]) -> DataFrame:
    """A CRASHED report for every expected module that left none."""
    expected = files.select("file_id", F.explode(F.array(*[F.lit(m) for m in modules])).alias("module"))
    got = reports.select("file_id", "module").distinct()
    return expected.join(got, ["file_id", "module"], "left_anti").select(
        "file_id", "module",
        F.lit("CRASHED").alias("status"), F.lit("CRASHED").alias("effective_status"),
        F.lit("Module failed after retries").alias("error"),
    )

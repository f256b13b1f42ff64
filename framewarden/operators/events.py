"""From reports to one normalised event table, and its export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wording as W
from ..functions.timecode import seconds_to_smpte


def collect_events(reports: DataFrame, top_level_only: bool = False) -> DataFrame:
    """Events of every report, top-level ones first, shifted by its offset.

    Needs ``file_id, report_ord, module, segment_offset_sec, events`` and
    ``details_events`` (arrays of event structs).  ``pos`` numbers a report's
    events, so ``(report_ord, pos)`` is the reading order.
    """
    none = F.array().cast(reports.schema["events"].dataType)
    every = F.coalesce("events", none)
    if not top_level_only:
        every = F.concat(every, F.coalesce("details_events", none))
    offset = F.coalesce("segment_offset_sec", F.lit(0.0))
    fields = [f for f in reports.schema["events"].dataType.elementType.fieldNames() if f != "source_module"]
    moved = {"start_time", "end_time"}
    return (
        reports.withColumn("_offset", offset)
        .select("file_id", "report_ord", "module", "_offset", F.posexplode(every).alias("pos", "_e"))
        .select(
            "file_id", "report_ord", "pos", F.col("module").alias("source_module"),
            *[(F.col(f"_e.{f}") + F.col("_offset") if f in moved else F.col(f"_e.{f}")).alias(f) for f in fields],
        )
    )


def normalize_event_time(events: DataFrame) -> DataFrame:
    """Fill start from ``timestamp`` and end from start; keep the origin."""
    start = W.event_start(F.col("start_time"), F.col("timestamp"))
    return events.withColumns(
        {"start_time": start, "end_time": W.event_end(F.col("end_time"), start), "origin_module": F.col("module")}
    ).drop("timestamp", "module")


def describe_events(events: DataFrame) -> DataFrame:
    """Adds category, export code, name, score, severity word and colour."""
    module = F.col("origin_module") if "origin_module" in events.columns else F.col("source_module")
    text = (F.col("type"), module, F.col("details"))
    category = W.event_category(*text)
    return events.withColumns(
        {
            "category": category,
            "datavyu_code": W.event_code(*text),
            "human_name": W.human_name(F.col("type")),
            "severity_score": W.severity_score(F.col("severity")),
            "original_severity": W.severity_word(F.col("severity")),
            "color": W.category_colour(category),
        }
    )


def datavyu_rows(described: DataFrame) -> DataFrame:
    """Annotation rows: whole milliseconds, codes and ``name: details``."""
    ms = lambda c: (F.coalesce(c, F.lit(0.0)) * 1000).cast("long")
    return described.select(
        "file_id",
        ms("start_time").alias("onset"),
        ms("end_time").alias("offset"),
        F.col("datavyu_code").alias("code01"),
        F.col("original_severity").alias("code02"),
        F.concat("human_name", F.lit(": "), F.coalesce("details", F.lit(""))).alias("comment"),
    )


def first_k_times(described: DataFrame, k: int = 3, keys=("file_id", "human_name")) -> DataFrame:
    """The ``k`` earliest occurrences of each issue, numbered from 1.

    Map tasks keep only their ``k`` earliest per issue before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("start_time", "ord")
    return (
        described.withColumn("nth", F.row_number().over(w))
        .where(F.col("nth") <= k)
        .select(*keys, "nth", "start_time", seconds_to_smpte(F.col("start_time")).alias("smpte"), "category")
    )


def issue_summary(described: DataFrame, keys=("file_id", "human_name"), k: int = 3) -> DataFrame:
    """Per issue: count, worst score, category, first ``k`` time codes and how many more, verdict."""
    keys = list(keys)
    totals = described.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("severity_score").alias("max_severity")
    )
    # At most k rows per issue.
    early = first_k_times(described, k, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("nth", "smpte", "category"))).alias("_early")
    )
    times = early.select(
        *keys,
        F.col("_early")[0]["category"].alias("category"),
        F.array_join(F.transform("_early", lambda e: e["smpte"]), ", ").alias("times"),
    )
    more = F.when(F.col("n") > k, F.concat(F.lit(" (+"), (F.col("n") - k).cast("string"), F.lit(" more)"))).otherwise("")
    return totals.join(times, keys).select(
        *keys, "n", "max_severity", "category",
        (F.col("max_severity") >= 3).alias("is_fail"),
        F.concat("times", more).alias("times"),
    )


def distinct_types(events: DataFrame) -> DataFrame:
    return events.select("file_id", "type").distinct()


def top_defects(events: DataFrame, k: int | None = None) -> DataFrame:
    """Event types per file in alphabetical order, as one text.

    With ``k`` only the first ``k``, and how many more there are.
    """
    kinds = F.array_sort(F.collect_set("type"))
    listed = events.groupBy("file_id").agg(kinds.alias("_kinds"))
    if k is None:
        return listed.select("file_id", F.array_join("_kinds", ", ").alias("defects"))
    more = F.when(F.size("_kinds") > k, F.concat(F.lit(" (+"), (F.size("_kinds") - k).cast("string"), F.lit(" more)"))).otherwise("")
    return listed.select("file_id", F.concat(F.array_join(F.slice("_kinds", 1, k), ", "), more).alias("defects"))


def executive_summary(results: DataFrame, events: DataFrame, k: int | None = None) -> DataFrame:
    """One row per processed file (``file_id, filename, status, duration``); ``k`` as in ``top_defects``."""
    return results.join(top_defects(events, k), "file_id", "left").select(
        "filename", "status", F.coalesce("defects", F.lit("")).alias("defects"), "duration"
    )


def failures_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("status") == "PASSED", "filename")


def timeline_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.coalesce("start_time", F.lit(0.0)), "type")


def batch_tally(outcomes: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "SUCCESS"
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"),
        (F.count(F.lit(1)) - F.count_if(ok)).alias("failed"),
    )

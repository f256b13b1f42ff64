"""Master report of many files: verdict, modules and stitched timeline.

The report stays three tables (one row per file, per module, per event); nesting
a file's whole timeline in one row would not scale with the file.  The JSON form
is written by ``sources.writers.write_master``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import collect_events, normalize_event_time
from ..operators.intervals import stitch_events, stitch_islands
from ..operators.segments import join_segment_offset, merge_segment_details, shift_times, tag_origin
from ..operators.verdicts import escalate, overall_status_of, reported_status, segment_summary, segment_worst_status
from ..profiles import governance


@dataclass(frozen=True)
class Master:
    files: DataFrame
    modules: DataFrame
    events: DataFrame


def module_table(reports: DataFrame) -> DataFrame:
    """A file's modules; a later report of the same module replaces the earlier.

    Reports with ``metrics`` keep those of the last one.
    """
    kept = [F.max_by("metrics", "ord").alias("metrics")] if "metrics" in reports.columns else []
    return reports.groupBy("file_id", "module").agg(F.max_by(reported_status(), "ord").alias("status"), *kept)


def master_report(
    reports: DataFrame, events: DataFrame, profiles: DataFrame, tolerance: float = 0.1, profile: str | None = None
) -> Master:
    """``reports``: ``file_id, ord, module, status, effective_status, profile``;
    ``events``: ``file_id, ord, type, start_time, end_time, severity, details``.

    ``profile`` names one profile for all files; then reports need no such column."""
    stitched = stitch_events(events, tolerance)
    keys = ["file_id"] if profile else ["file_id", "profile"]
    verdicts = reports.groupBy(*keys).agg(
        overall_status_of("ord").alias("overall_status"), F.count_distinct("module").alias("n_modules")
    )
    # The verdict needs numbers only.
    counts = stitch_islands(events, tolerance).islands.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("start_time").alias("first_event"), F.max("end_time").alias("last_event")
    )
    files = (
        governance(verdicts, profiles, name=profile)
        .join(counts, "file_id", "left")
        .withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    )
    return Master(files, module_table(reports), stitched)


def report_events(reports: DataFrame, normalize: bool = False, top_level_only: bool = False) -> DataFrame:
    """Events of nested report documents, ready for stitching.

    Untimed, untyped events stay as they are and meet in one group; ``normalize``
    fills their times first.
    """
    events = collect_events(reports, top_level_only)
    # Reading order: reports in order, events in order within each.  The widest
    # decimal has room for any two 64-bit counters.
    wide = F.col("report_ord").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    ordered = events.withColumn("ord", (wide + F.col("pos")).cast("decimal(38,0)"))
    if normalize:
        ordered = normalize_event_time(ordered.withColumn("module", F.col("source_module")))
    return ordered


def segmented_master(reports: DataFrame, events: DataFrame, values: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Fold segment results: verdicts, merged metrics, shifted and stitched events.

    ``reports``: ``file_id, segment_id, module, status``; ``values``: ``file_id,
    segment_id, module, key, v``; ``events`` carry segment-relative times.
    """
    status = F.coalesce(reported_status("PASSED"), F.lit("PASSED")) if "effective_status" in reports.columns else None
    modules = escalate(reports, ["file_id", "module"], status)
    files = escalate(modules, ["file_id"]).join(segment_summary(reports), "file_id")
    shifted = shift_times(join_segment_offset(events, segments))
    return {
        "files": files,
        "modules": modules,
        "details": merge_segment_details(values),
        "events": stitch_events(shifted),
    }


def merged_segments_flat(segment_masters: DataFrame, events: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Flat form: worst segment verdict, and shifted events tagged with their segment."""
    shifted = shift_times(join_segment_offset(events, segments))
    label = F.format_string("segment_%04d.mp4", "segment_id")
    return {
        "files": segment_worst_status(segment_masters, order="segment_id"),
        "events": tag_origin(shifted, label),
    }

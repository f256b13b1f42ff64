"""Checks of frames, signal levels, black/freeze, interlacing, artifacts, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import PASSED, REJECTED, WARNING, event, flags_by_file, is_strict, list_events


def bitrate_starvation(bitrates: DataFrame, limit: float = 0.02) -> DataFrame:
    """Critical event when a file has too few bits for its picture size."""
    area = F.col("width") * F.col("height")
    bpp = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("bit_rate") / area)
    return bitrates.withColumn("bpp", bpp).where(F.col("bpp") < limit)


def bitrate_events(bitrates: DataFrame, limit: float = 0.02) -> DataFrame:
    return list_events(
        bitrate_starvation(bitrates, limit),
        event("bitrate_starvation", F.format_string("Critical Bitrate Starvation (%.4f bpp).", "bpp"),
              F.lit(0.0), F.lit(0.0), F.lit("CRITICAL")),
    )


def artifact_status(files: DataFrame, events: DataFrame) -> DataFrame:
    sev = F.col("severity")
    flagged = flags_by_file(
        files, events, _bad=sev.isin("CRITICAL", "SEVERE"), _warn=sev.isin("WARNING", "MODERATE")
    )
    status = F.when(F.col("_bad"), REJECTED).when(F.col("_warn"), WARNING).otherwise(PASSED)
    return flagged.withColumn("status", status).drop("_bad", "_warn")


def fade_classify(black: DataFrame) -> DataFrame:
    """Black stretches at the very start or end are fades, the rest errors.

    Needs ``start_time, end_time`` and the file's ``duration_sec``.
    """
    kind = (
        F.when(F.col("start_time") < 1.0, "fade_in")
        .when(F.col("end_time") > F.col("duration_sec") - 1.0, "fade_out")
        .otherwise("black_frame_error")
    )
    return black.withColumn("type", kind)


def black_freeze_status(files: DataFrame, events: DataFrame) -> DataFrame:
    flagged = flags_by_file(files, events, _bad=F.col("type").isin("video_freeze", "black_frame_error"))
    return flagged.withColumn("status", F.when(F.col("_bad"), REJECTED).otherwise(PASSED)).drop("_bad")


def frame_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """``files`` carries ``duplicate_frame_count``."""
    kind = F.col("type")
    flagged = flags_by_file(
        files, events, _bad=kind.isin("non_monotonic_pts", "corrupt_packet"), _gap=kind == "frame_gap"
    )
    status = (
        F.when(F.col("_bad"), REJECTED)
        .when((F.col("duplicate_frame_count") > 24) | F.col("_gap"), WARNING)
        .otherwise(PASSED)
    )
    return flagged.withColumn("status", status).drop("_bad", "_gap")


def analog_status(spikes: Column) -> Column:
    return F.when(spikes > 10, REJECTED).when(spikes > 0, WARNING).otherwise(PASSED)


def signal_status(files: DataFrame, bursts: DataFrame, total_frames: str = "total_frames") -> DataFrame:
    """No frames at all is a warning; the clean word is normalised to PASSED."""
    flagged = flags_by_file(files, bursts, _bad=F.col("severity") == REJECTED, _any=F.lit(True))
    status = (
        F.when(F.coalesce(total_frames, F.lit(0)) == 0, WARNING)
        .when(F.col("_bad"), REJECTED)
        .when(F.col("_any"), WARNING)
        .otherwise(PASSED)
    )
    return flagged.withColumn("status", status).drop("_bad", "_any")


def signal_metrics(frames: DataFrame) -> DataFrame:
    """Luma extremes and counts of out-of-range frames (a frame can count twice)."""
    count = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    under, over = count(F.col("ymin") < 16), count(F.col("ymax") > 235)
    return frames.groupBy("file_id").agg(
        F.least(F.lit(255), F.min("ymin")).alias("signal_min_y"),
        F.greatest(F.lit(0), F.max("ymax")).alias("signal_max_y"),
        F.sum(under + over).alias("broadcast_illegal_frames"),
        F.count_if(F.col("satmax") > 110).alias("saturation_warnings"),
        F.count(F.lit(1)).alias("total_frames"),
    )


def quality_metrics(scored: DataFrame) -> DataFrame:
    """Frames analysed, average and worst score; unusable scores (< 0) aside."""
    cents = F.sum(F.round(F.col("score") * 100).cast("long"))
    return scored.where(F.col("score") >= 0).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.round(cents / (F.count(F.lit(1)) * 100), 2).alias("avg_quality_score"),
        F.round(F.max("score"), 2).alias("worst_score"),
    )


# Sync limits in milliseconds.
SYNC_TOLERANCE_MS = 40.0
DRIFT_LIMIT_MS = 15.0


def avsync_status(offsets: DataFrame, mode: Column | str = "strict", tolerance: Column | float = SYNC_TOLERANCE_MS) -> DataFrame:
    """Needs ``offset_head_ms, offset_tail_ms, drift_ms``; adds ``max_offset_ms, status``."""
    worst = F.greatest(F.abs("offset_head_ms"), F.abs("offset_tail_ms"))
    over = F.col("max_offset_ms") > tolerance
    status = (
        F.when(over & is_strict(mode), REJECTED)
        .when(over | (F.abs("drift_ms") > DRIFT_LIMIT_MS), WARNING)
        .otherwise(PASSED)
    )
    return offsets.withColumn("max_offset_ms", worst).withColumn("status", status)


def avsync_events(checked: DataFrame) -> DataFrame:
    """One event over the whole file (``duration_sec``) unless it passed."""
    length = F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.lit(0.1))
    return list_events(
        checked.where(F.col("status") != PASSED),
        event(
            "av_sync_error",
            F.format_string("A/V Sync Offset: %.2fms (Limit: %.1fms)", "max_offset_ms", F.lit(SYNC_TOLERANCE_MS)),
            F.lit(0.0), length, F.col("status"),
        ),
    )


def interlace_status(metrics: DataFrame, mode: Column | str = "strict", psnr_threshold: float = 32.0) -> DataFrame:
    """Needs ``has_events`` and ``avg_psnr``; a low average alone is a warning."""
    low = (F.col("avg_psnr") > 0) & (F.col("avg_psnr") < psnr_threshold + 3)
    status = (
        F.when(F.col("has_events") & is_strict(mode), REJECTED)
        .when(F.col("has_events") | low, WARNING)
        .otherwise(PASSED)
    )
    return metrics.withColumn("status", status)

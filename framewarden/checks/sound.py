"""Checks of loudness, audio signal and phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profiles import DEFAULTS, join_profile, setting
from .base import PASSED, REJECTED, WARNING, event, flags_by_file, list_events

NO_AUDIO = -99.0


def _limits(loudness: DataFrame, profiles: DataFrame) -> DataFrame:
    return join_profile(loudness, profiles).withColumns(
        {
            "target": setting("integrated_loudness_target"),
            "tolerance": setting("loudness_tolerance"),
            "peak_limit": setting("true_peak_max"),
        }
    )


def _findings():
    measured = F.col("integrated_lufs") != NO_AUDIO
    low, high = F.col("target") - F.col("tolerance"), F.col("target") + F.col("tolerance")
    off_target = measured & ~F.col("integrated_lufs").between(low, high)
    return ~measured, off_target, measured & (F.col("true_peak") > F.col("peak_limit"))


def loudness_check(loudness: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``loudness_ok, peak_ok, status, effective_status`` per file."""
    missing, off_target, hot = _findings()
    status = F.when(missing, WARNING).when(off_target | hot, REJECTED).otherwise(PASSED)
    return (
        _limits(loudness, profiles)
        .withColumns({"loudness_ok": ~off_target, "peak_ok": ~hot, "status": status})
        .withColumn("effective_status", F.when(F.col("status") == REJECTED, REJECTED).otherwise(PASSED))
        .select(*loudness.columns, "target", "tolerance", "peak_limit", "loudness_ok", "peak_ok", "status", "effective_status")
    )


def loudness_events(loudness: DataFrame, profiles: DataFrame) -> DataFrame:
    missing, off_target, hot = _findings()
    text = lambda c: F.col(c).cast("string")
    return list_events(
        _limits(loudness, profiles),
        F.when(
            missing,
            event("missing_audio", F.lit("Audio analysis returned no data (Possible silent track or no audio stream)."),
                  severity=F.lit("medium")),
        ),
        F.when(
            off_target,
            event("loudness_violation", F.concat(
                F.lit("Integrated Loudness "), text("integrated_lufs"), F.lit(" LUFS is outside target "), text("target"),
                F.lit(" +/- "), text("tolerance"), F.lit(".")), severity=F.lit("high")),
        ),
        F.when(
            hot,
            event("true_peak_violation", F.concat(
                F.lit("True Peak "), text("true_peak"), F.lit(" dBTP exceeds limit "), text("peak_limit"), F.lit(" dBTP.")),
                severity=F.lit("high")),
        ),
    )


# Target levels of the loudness repair.
REPAIR_TARGETS = {"integrated": -23.0, "true_peak": -1.0, "range": 7.0}


def remediation_worklist(checked: DataFrame) -> DataFrame:
    """Files to repair and the gain that brings them to the target loudness."""
    return checked.where(F.col("effective_status").isin(REJECTED, WARNING)).withColumn(
        "gain_db", F.lit(REPAIR_TARGETS["integrated"]) - F.col("integrated_lufs")
    )


def audio_signal_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """Verdict from dropouts, critical findings and the file's ``dc_offset_max``."""
    dropout = F.col("type") == "audio_dropout"
    length = F.coalesce("end_time", F.lit(0.0)) - F.coalesce("start_time", F.lit(0.0))
    flagged = flags_by_file(
        files, events,
        _bad=F.coalesce(F.col("severity") == "CRITICAL", F.lit(False)) | (dropout & (length > 2.0)),
        _drop=dropout,
    )
    status = (
        F.when(F.col("_bad"), REJECTED)
        .when(F.col("_drop") | (F.col("dc_offset_max") > 0.001), WARNING)
        .otherwise(PASSED)
    )
    return flagged.withColumn("status", status).drop("_bad", "_drop")


def audio_metrics(logs: DataFrame) -> DataFrame:
    """Largest DC offset, last dynamic range and first peak volume per log."""
    from ..functions.logs import astats_values

    v = astats_values(F.col("line"))
    has = lambda c: F.when(c.isNotNull(), F.col("line_no"))
    return logs.groupBy("file_id").agg(
        F.coalesce(F.max(F.abs(v["dc_offset"])), F.lit(0.0)).alias("dc_offset_max"),
        F.coalesce(F.max_by(v["dynamic_range"], has(v["dynamic_range"])), F.lit(0.0)).alias("dynamic_range_db"),
        F.coalesce(F.min_by(v["max_volume"], has(v["max_volume"])), F.lit(NO_AUDIO)).alias("peak_volume_db"),
    )


def phase_metrics(audio_frames: DataFrame) -> DataFrame:
    return audio_frames.groupBy("file_id").agg(
        F.avg("phase").alias("mean_phase"), F.min("phase").alias("min_phase")
    ).select(
        "file_id", "mean_phase", "min_phase",
        F.round("mean_phase", 4).alias("mean_phase_correlation"),
        F.round("min_phase", 4).alias("min_phase_correlation"),
    )


def phase_status(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Needs ``profile``; no phase data (null) is a warning."""
    mean, low = F.col("mean_phase"), F.col("min_phase")
    limits = profiles.select("profile", F.col("min_phase_correlation").alias("phase_limit"))
    status = (
        F.when(mean.isNull(), WARNING)
        .when(mean < F.coalesce("phase_limit", F.lit(DEFAULTS["min_phase_correlation"])), REJECTED)
        .when(low < -0.5, WARNING)
        .otherwise(PASSED)
    )
    return join_profile(metrics, limits).withColumn("status", status).select(*metrics.columns, "status")

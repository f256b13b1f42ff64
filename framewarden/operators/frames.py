"""Operators along the frame counter: gaps, drift, duplicates, runs, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import abs_difference, changed_samples, field, field_sums, psnr, ssim
from .chunks import CHUNK_ROWS, with_previous
from .islands import consecutive_runs, gap_islands

KEYS = ("file_id",)


def frame_interval_ms(fps: float) -> float:
    return 1000.0 / (fps if fps > 0 else 24.0)


def frame_gaps(frames: DataFrame, fps: float, keys: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Time jumps of more than one and a half frame durations."""
    step = frame_interval_ms(fps)
    pairs = with_previous(frames.select(*keys, "frame_idx", "pts_us"), keys, "frame_idx", {"_prev": "pts_us"}, chunk_rows)
    delta = (F.col("pts_us") - F.col("_prev")) / 1000.0
    return pairs.where((F.col("_prev") >= 0) & (delta > step * 1.5)).select(
        *keys, "frame_idx",
        F.lit("frame_gap").alias("type"),
        (F.col("_prev") / 1e6).alias("start_time"),
        (F.col("pts_us") / 1e6).alias("end_time"),
        F.format_string("Time jump of %.2fms (Expected %.2fms)", delta, F.lit(step)).alias("details"),
    )


def max_pts_drift(frames: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest distance between a frame's time and its nominal time, frame 0 aside."""
    off = F.abs(F.col("pts_us") / 1000.0 - F.col("frame_idx") * frame_interval_ms(fps))
    return frames.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("frame_idx") > 0, off)), F.lit(0.0)).alias("max_pts_drift_ms")
    )


def drift_events(drift: DataFrame, limit_ms: float = 100.0, keys: Sequence[str] = KEYS) -> DataFrame:
    return drift.where(F.col("max_pts_drift_ms") > limit_ms).select(
        *keys,
        F.lit("timestamp_drift").alias("type"),
        F.format_string("High PTS Drift detected (Max: %.2fms).", "max_pts_drift_ms").alias("details"),
        F.lit("WARNING").alias("severity"),
    )


def mark_duplicates(
    pixels: DataFrame, max_changed: int = 50, keys: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``is_dup``: fewer than ``max_changed`` samples differ from the frame before."""
    pairs = with_previous(pixels, keys, "frame_idx", {"_prev": "px"}, chunk_rows)
    dup = F.col("_prev").isNotNull() & (changed_samples(F.col("px"), F.col("_prev")) < max_changed)
    return pairs.withColumn("is_dup", dup).drop("_prev", "px")


def duplicate_count(marked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return marked.groupBy(*keys).agg(F.count_if("is_dup").alias("duplicate_frame_count"))


def freeze_runs(
    marked: DataFrame, fps: float, keys: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Runs of duplicates longer than two frames; one still open at the end is dropped.

    Input: ``keys, frame_idx, pts_us, is_dup``.
    """
    rate = fps if fps > 0 else 24.0
    runs = consecutive_runs(
        marked, keys, "frame_idx", F.col("is_dup"),
        {"start_us": ("first", "pts_us"), "end_us": ("last", "pts_us")}, chunk_rows,
    )
    last = marked.groupBy(*keys).agg(F.max("frame_idx").alias("_last"))
    start, end = F.col("start_us") / 1e6, F.col("end_us") / 1e6
    return (
        runs.join(last, list(keys))
        .where((F.col("last_idx") < F.col("_last")) & (end - start > 2.0 / rate))
        .select(
            *keys,
            F.lit("freeze_frame").alias("type"),
            start.alias("start_time"), end.alias("end_time"),
            F.format_string("Content frozen for %.2fs", end - start).alias("details"),
        )
    )


def vrep_runs(
    frames: DataFrame, threshold: float = 5.0, persistence: int = 3, keys: Sequence[str] = KEYS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Line-repetition spikes over at least ``persistence`` consecutive frames."""
    runs = consecutive_runs(
        frames.withColumn("_one", F.lit(1).cast("long")), keys, "frame_idx", F.col("vrep") > threshold,
        {"duration_frames": ("sum", "_one"), "value": ("max", "vrep"), "start_us": ("first", "pts_us")}, chunk_rows,
    )
    return runs.where(F.col("duration_frames") >= persistence).select(
        *keys,
        (F.col("start_us") / 1e6).alias("timestamp"),
        F.lit("VREP").alias("metric"),
        "value", "duration_frames",
        F.format_string(
            "Analog Dropout / TBC Compensation (VREP Spikes: %d frames)", "duration_frames"
        ).alias("details"),
    )


def vrep_spike_count(frames: DataFrame, runs: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs per file, 0 included; ``runs`` from :func:`vrep_runs` if at hand."""
    found = vrep_runs(frames, keys=keys) if runs is None else runs
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    files = frames.select(*keys).distinct()
    return files.join(counts, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("vrep_spikes"))


def timeseries_thin(frames: DataFrame, above: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    return frames.where(F.col("vrep") > above).select(
        *keys, "frame_idx", (F.col("pts_us") / 1e6).alias("t"), F.col("vrep").alias("val")
    )


def threshold_runs(
    frames: DataFrame, column: str, threshold: float, min_duration: float, below: bool = True,
    keys: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Stretches where a level stays below (or above) a threshold long enough."""
    level = F.col(column)
    runs = consecutive_runs(
        frames, keys, "frame_idx", level < threshold if below else level > threshold,
        {"start_us": ("first", "pts_us"), "end_us": ("last", "pts_us")}, chunk_rows,
    )
    start, end = F.col("start_us") / 1e6, F.col("end_us") / 1e6
    return runs.where(end - start >= min_duration).select(
        *keys, "first_idx", "last_idx", start.alias("start_time"), end.alias("end_time")
    )


# Level, direction and least duration of the standard detectors.
DETECTORS = {
    "silence": {"threshold": -50.0, "below": True, "min_duration": 0.1},
    "black": {"threshold": 0.10, "below": True, "min_duration": 2.0},
    "freeze": {"threshold": -60.0, "below": True, "min_duration": 2.0},
}


def sampling_step(fps: Column, rate: Column) -> Column:
    """Frames per sample, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(fps / rate).cast("int"))


def sample_every_nth(frames: DataFrame, step: int | Column, first_seconds: float | None = None, fps: float = 25.0) -> DataFrame:
    """Every ``step``-th frame, optionally only up to ``first_seconds``."""
    keep = F.col("frame_idx") % step == 0
    if first_seconds is not None:
        keep = keep & (F.col("frame_idx") <= fps * first_seconds)
    return frames.where(keep)


def micro_batch_limit(frames: DataFrame, seconds: int = 30, fps: int = 25) -> DataFrame:
    """The first ``seconds`` of each file at the nominal rate."""
    return frames.where(F.col("frame_idx") < seconds * fps)


def field_metrics(pixels: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per file: agreement of even and odd rows, and change of the odd rows.

    Only every other frame is looked at.  Each frame is measured in its own row;
    only the odd field travels for the comparison with the frame before.
    """
    measured = (
        pixels.where(F.col("frame_idx") % 2 == 0)
        .withColumns({"odd": field(F.col("px"), F.col("width"), 1), "even": field(F.col("px"), F.col("width"), 0)})
        .withColumn("s", field_sums(F.col("even"), F.col("odd")))
        .select(
            *keys,
            F.floor(F.col("frame_idx") / 2).alias("_half"),
            psnr(F.col("s.dd") / F.col("s.n")).alias("psnr"),
            ssim(F.col("s")).alias("ssim"),
            "odd",
        )
    )
    pairs = with_previous(measured, keys, "_half", {"_prev": "odd"}, chunk_rows)
    change = abs_difference(F.col("odd"), F.col("_prev")) / F.size("odd")
    return pairs.withColumn("div", F.when(F.col("_prev").isNotNull(), change)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("psnr").alias("avg_psnr"),
        F.min("psnr").alias("min_psnr"),
        F.avg("ssim").alias("avg_ssim"),
        F.min("ssim").alias("min_ssim"),
        F.coalesce(F.avg("div"), F.lit(0.0)).alias("avg_temp_div"),
    )


SEVERITIES = ("UNKNOWN", "MILD", "MODERATE", "SEVERE")


def stitch_ml_events(
    scored: DataFrame, min_duration: float | str = 1.0, gap: float = 1.5, keys: Sequence[str] = KEYS,
    width: float = 600.0,
) -> DataFrame:
    """Join scored frames that are not clean into artifact events.

    Input: ``keys, ts, ord, score, severity``.  An event takes its first frame's
    severity and is raised to SEVERE by any severe frame; short ones are dropped
    unless severe.  ``min_duration`` is a number or a column of the file's own.  Scores have two decimals and are summed as whole hundredths,
    so the average does not depend on how the rows were spread.
    """
    dirty = scored.where(F.col("severity") != "CLEAN")
    # Numbered, so that the aggregates below stay hash-based.
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    least = F.col(min_duration) if isinstance(min_duration, str) else F.lit(float(min_duration))
    points = dirty.withColumns({"_level": level, "_least": least}).groupBy(*keys, "ts").agg(
        F.min_by("_level", "ord").alias("first"),
        F.bool_or(F.col("severity") == "SEVERE").alias("severe"),
        F.sum(F.round(F.col("score") * 100).cast("long")).alias("cents"),
        F.count(F.lit(1)).alias("n"),
        F.max("score").alias("peak"),
        F.max("_least").alias("least"),
    )
    joined = gap_islands(
        points, keys, "ts", gap,
        {"first": ("first", "first"), "severe": ("any", "severe"), "cents": ("sum", "cents"), "n": ("sum", "n"),
         "peak": ("max", "peak"), "least": ("max", "least")},
        width,
    )
    named = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("first").cast("int"))
    severity = F.when(F.col("severe"), F.lit("SEVERE")).otherwise(named)
    average = F.col("cents") / (F.col("n") * 100)
    return (
        joined.withColumn("severity", severity)
        .where((F.col("end_at") - F.col("start_at") >= F.col("least")) | F.col("severe"))
        .select(
            *keys,
            F.lit("compression_artifact_ml").alias("type"),
            F.col("start_at").alias("start_time"),
            F.col("end_at").alias("end_time"),
            "severity",
            F.format_string("ML detected %s artifacts (Avg Score: %.1f)", "severity", average).alias("details"),
            F.col("n").alias("n_frames"),
            average.alias("avg_score"),
            F.col("peak").alias("peak_score"),
        )
    )

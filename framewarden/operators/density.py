"""Rolling-window density of out-of-range frames, merged into bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import violation_confidence
from .chunks import CHUNK_US, time_chunk, with_lookback
from .islands import gap_islands


def frame_violations(
    frames: DataFrame, keys: Sequence[str], ymin_safe: int = 16, ymax_safe: int = 235, sat_max: int = 110,
    confidence: float = 0.8,
) -> DataFrame:
    """One row per distinct frame time: its violation counts and worst values.

    Clean frames stay: a burst lasts while the window behind them is still dense.
    """
    # A level that could not be read violates nothing.
    known = lambda c: F.coalesce(c, F.lit(False))
    under, over, sat = known(F.col("ymin") < ymin_safe), known(F.col("ymax") > ymax_safe), known(F.col("satmax") > sat_max)
    under_conf = violation_confidence(F.col("ymin"), F.lit(ymin_safe)) * 100.0
    over_conf = violation_confidence(F.col("ymax"), F.lit(ymax_safe)) * 100.0
    high = F.lit(confidence * 100.0)
    hi_under, hi_over = under & (under_conf >= high), over & (over_conf >= high)
    # Of two violations in one frame the upper limit is checked last.
    worst = F.when(hi_over, F.col("ymax")).when(hi_under, F.col("ymin"))
    top = F.greatest(F.when(hi_under, under_conf), F.when(hi_over, over_conf))
    return (
        frames.select(
            *keys, "pts_us", "frame_idx",
            (hi_under.cast("int") + hi_over.cast("int")).alias("n_high"),
            worst.alias("worst"), top.alias("conf"),
            F.when(under | over | sat, F.col("pts_us")).alias("bad_us"),
        )
        .groupBy(*keys, "pts_us")
        .agg(
            F.sum("n_high").alias("n_high"),
            F.max_by("worst", F.when(F.col("worst").isNotNull(), F.col("frame_idx"))).alias("worst"),
            F.max("conf").alias("conf"),
            F.max("bad_us").alias("bad_us"),
        )
    )


def window_density(times: DataFrame, keys: Sequence[str], window_us: int, width: int) -> DataFrame:
    """``n, first_us, worst, conf`` over ``(pts_us - window_us, pts_us]`` at each time.

    A sliding frame would be summed anew for every row.  Instead time is cut
    into blocks as long as the window: a window is the tail of the block before
    plus the beginning of its own, and both are running aggregates.  Each time
    appears once in its own block and once, shifted by the window, in the next
    one, where its place marks the moment it drops out.
    """
    near = with_lookback(times, "pts_us", window_us, width)
    both = (
        near.withColumn("_late", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_pos", F.col("pts_us") + F.col("_late") * F.lit(window_us))
        .withColumn("_block", time_chunk("_pos", window_us))
    )
    block = Window.partitionBy(*keys, "_chunk", "_block")
    so_far = block.orderBy(F.asc("_pos"), F.desc("_late")).rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, the rows above are the earlier block's times still inside.
    inside = block.orderBy(F.desc("_pos"), F.asc("_late")).rowsBetween(Window.unboundedPreceding, -1)
    new = lambda c: F.when(F.col("_late") == 0, F.col(c))
    old = lambda c: F.when(F.col("_late") == 1, F.col(c))
    return (
        both.withColumns(
            {
                "_n": F.sum(new("n_high")).over(so_far),
                "_first": F.min(new("bad_us")).over(so_far),
                "_worst": F.last(new("worst"), ignorenulls=True).over(so_far),
                "_conf": F.max(new("conf")).over(so_far),
                "_old_n": F.sum(old("n_high")).over(inside),
                "_old_first": F.min(old("bad_us")).over(inside),
                # Backwards, the first one met is the latest in time.
                "_old_worst": F.first(old("worst"), ignorenulls=True).over(inside),
                "_old_conf": F.max(old("conf")).over(inside),
            }
        )
        .where(F.col("_own") & (F.col("_late") == 0))
        .select(
            *keys, "pts_us",
            (F.coalesce("_n", F.lit(0)) + F.coalesce("_old_n", F.lit(0))).alias("n"),
            F.coalesce("_old_first", "_first").alias("first_us"),
            F.coalesce("_worst", "_old_worst").alias("worst"),
            F.greatest("_conf", "_old_conf").alias("conf"),
        )
    )


def broadcast_bursts(
    frames: DataFrame,
    mode: str = "strict",
    keys: Sequence[str] = ("file_id",),
    min_count: int = 10,
    window_us: int = 2_000_000,
    gap_us: int = 500_000,
    width: int = CHUNK_US,
    **limits,
) -> DataFrame:
    """Stretches where more than ``min_count`` high-confidence luma violations
    fall into the last ``window_us`` (lower edge excluded)."""
    keys = list(keys)
    density = window_density(frame_violations(frames, keys, **limits), keys, window_us, width)
    hot = density.where(F.col("n") > min_count).drop("n")
    bursts = gap_islands(
        hot, keys, "pts_us", gap_us,
        {"start_us": ("first", "first_us"), "worst": ("first", "worst"), "confidence": ("first", "conf")},
        width=width,
    )
    return bursts.select(
        *keys,
        F.lit("broadcast_illegal_burst").alias("type"),
        (F.col("start_us") / 1e6).alias("start_time"),
        (F.col("end_at") / 1e6).alias("end_time"),
        F.lit("REJECTED" if mode == "strict" else "WARNING").alias("severity"),
        F.concat(F.lit("sustained broadcast violation (>10 frames/2s). Worst: "), F.col("worst").cast("string")).alias(
            "details"
        ),
        "confidence",
    )

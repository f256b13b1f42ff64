"""Segments of a file: planning, assigning, and merging their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import index_chunk

TIME_FIELDS = ("timestamp", "start_sec", "end_sec", "start_time", "end_time")


def plan_segments(files: DataFrame, segment_sec: float = 300.0) -> DataFrame:
    """Fixed-length segments of each file (``duration_sec``); none for empty files."""
    total = F.col("duration_sec")
    n = F.ceil(total / segment_sec)
    start = F.col("segment_id") * F.lit(float(segment_sec))
    return (
        files.where(total > 0)
        .select("file_id", "duration_sec", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("segment_id"))
        .select(
            "file_id", F.col("segment_id").cast("int").alias("segment_id"), start.alias("start_time"),
            F.least(F.lit(float(segment_sec)), total - start).alias("duration"),
        )
    )


def assign_segment(seconds: Column, segment_sec: float = 300.0) -> Column:
    return F.floor(seconds / segment_sec).cast("int")


def join_segment_offset(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Bring each segment's start to its rows.

    Rows of segments that are not listed stay, with an offset of 0 and ``listed``
    false.  The segment table is small next to the events; Spark broadcasts it
    only if its measured size allows.
    """
    offsets = segments.select("file_id", "segment_id", F.col("start_time").alias("segment_start"), F.lit(True).alias("listed"))
    return events.join(offsets, ["file_id", "segment_id"], "left").withColumns({
        "segment_start": F.coalesce("segment_start", F.lit(0.0)), "listed": F.coalesce("listed", F.lit(False)),
    })


def shift_times(events: DataFrame, offset: str = "segment_start") -> DataFrame:
    """Add the offset to every time column present, to the millisecond."""
    present = [c for c in TIME_FIELDS if c in events.columns]
    return events.withColumns({c: F.round(F.col(c) + F.col(offset), 3) for c in present})


def tag_origin(events: DataFrame, label: Column) -> DataFrame:
    return events.withColumn(
        "details", F.concat(F.lit("["), label, F.lit("] "), F.coalesce("details", F.lit("")))
    )


def merge_rule(key: Column) -> Column:
    low = F.lower(key)
    has = lambda c, word: F.contains(c, F.lit(word))
    return (
        F.when(has(key, "mean_phase"), "pairwise")
        .when(has(key, "min_phase"), "min")
        .when(has(low, "offset") | has(low, "error"), "max")
        .otherwise("first")
    )


def merge_segment_details(
    values: DataFrame, keys: Sequence[str] = ("file_id", "module", "key"), chunk_rows: int = 1 << 12
) -> DataFrame:
    """One value per key over the file's segments in order.

    Input: ``keys, segment_id, v``, one value per segment; the last of ``keys``
    is the metric's name.  The pairwise rule folds ``(a + b) / 2``: the k-th value
    from the end weighs 2^-k, the first one twice that.  Weighted sums add up
    over chunks of segments, so no key is folded in one piece.
    """
    keys = list(keys)
    rows = values.withColumn("_chunk", index_chunk("segment_id", chunk_rows))
    back = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("segment_id"))
    chunks = (
        rows.withColumn("_w", F.col("v") * F.pow(F.lit(2.0), -F.row_number().over(back)))
        .groupBy(*keys, "_chunk")
        .agg(
            F.sum("_w").alias("_s"),
            F.count(F.lit(1)).alias("_n"),
            F.min_by("v", "segment_id").alias("_first"),
            F.min("v").alias("_min"),
            F.max("v").alias("_max"),
        )
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("_n").over(later), F.lit(0))
    folded = (
        chunks.withColumn("_s", F.col("_s") * F.pow(F.lit(2.0), -after))
        .groupBy(*keys)
        .agg(
            F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.min_by("_first", "_chunk").alias("_first"),
            F.min("_min").alias("_min"), F.max("_max").alias("_max"),
        )
    )
    rule = merge_rule(F.col(keys[-1]))
    value = (
        F.when(rule == "pairwise", F.col("_s") + F.col("_first") * F.pow(F.lit(2.0), -F.col("_n")))
        .when(rule == "min", F.col("_min"))
        .when(rule == "max", F.col("_max"))
        .otherwise(F.col("_first"))
    )
    return folded.select(*keys, value.alias("v"))

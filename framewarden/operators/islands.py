"""Runs and islands: partial results per chunk, then only chunk edges meet.

A run inside a chunk is finished unless it touches the chunk's edge.  Edge
pieces (at most two per chunk) get the slot ``-1`` and are merged per file; all
other pieces keep their chunk as slot.  Grouping by ``(keys, slot)`` therefore
stays spread over the cluster however long one file is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, index_chunk, time_chunk

Aggs = dict[str, tuple[str, str]]

_PLAIN = {"min": F.min, "max": F.max, "sum": F.sum, "any": F.bool_or}


def _pick(op: str, column: str, at: str) -> Column:
    if op == "first":
        return F.min_by(column, at)
    if op == "last":
        return F.max_by(column, at)
    return _PLAIN[op](column)


def _join_edges(
    partial: DataFrame, keys: Sequence[str], start: str, end: str, edge: Column, opens: Column, aggs: Aggs
) -> DataFrame:
    """``opens(previous_end)``: does a piece begin a new island?"""
    slotted = partial.withColumn("_slot", F.when(edge, F.lit(-1).cast("long")).otherwise(F.col("_chunk")))
    w = Window.partitionBy(*keys, "_slot").orderBy(start)
    prev = F.lag(end).over(w)
    return (
        slotted.withColumn("_new", F.when(prev.isNull() | opens(prev), 1).otherwise(0))
        .withColumn("_isl", F.sum("_new").over(w))
        .groupBy(*keys, "_slot", "_isl")
        .agg(
            F.min(start).alias(start),
            F.max(end).alias(end),
            *[_pick(op, out, start).alias(out) for out, (op, _) in aggs.items()],
        )
        .drop("_slot", "_isl")
    )


def consecutive_runs(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    flag: Column,
    aggs: Aggs | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Maximal runs of flagged rows along the counter ``idx``.

    Returns ``keys, first_idx, last_idx`` and ``aggs`` (``min max sum any first
    last`` over a column).
    """
    aggs = aggs or {}
    hits = df.where(flag).withColumn("_chunk", index_chunk(idx, chunk_rows))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    partial = (
        hits.withColumn("_isl", F.col(idx) - F.row_number().over(w))
        .groupBy(*keys, "_chunk", "_isl")
        .agg(
            F.min(idx).alias("first_idx"),
            F.max(idx).alias("last_idx"),
            *[_pick(op, c, idx).alias(out) for out, (op, c) in aggs.items()],
        )
        .drop("_isl")
    )
    edge = (F.col("first_idx") % chunk_rows == 0) | (F.col("last_idx") % chunk_rows == chunk_rows - 1)
    return _join_edges(
        partial, keys, "first_idx", "last_idx", edge, lambda prev: F.col("first_idx") != prev + 1, aggs
    )


def gap_islands(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap: float,
    aggs: Aggs | None = None,
    width: float = 600.0,
) -> DataFrame:
    """Group points whose distance to the previous point is at most ``gap``.

    ``(keys, ts)`` must be unique: callers combine equal times first, which
    also bounds a chunk by its number of distinct times.  Returns ``keys,
    start_at, end_at`` and ``aggs``.
    """
    aggs = aggs or {}
    points = df.withColumn("_chunk", time_chunk(ts, width))
    parts = [*keys, "_chunk"]
    w = Window.partitionBy(*parts).orderBy(ts)
    prev = F.lag(ts).over(w)
    partial = (
        points.withColumn("_new", F.when(prev.isNull() | (F.col(ts) - prev > gap), 1).otherwise(0))
        .withColumn("_isl", F.sum("_new").over(w))
        .groupBy(*parts, "_isl")
        .agg(
            F.min(ts).alias("start_at"),
            F.max(ts).alias("end_at"),
            *[_pick(op, c, ts).alias(out) for out, (op, c) in aggs.items()],
        )
        .withColumn("_top", F.max("_isl").over(Window.partitionBy(*parts)))
    )
    edge = (F.col("_isl") == 1) | (F.col("_isl") == F.col("_top"))
    return _join_edges(
        partial.withColumn("_edge", edge).drop("_isl", "_top"),
        keys,
        "start_at",
        "end_at",
        F.col("_edge"),
        lambda prev: F.col("start_at") - prev > gap,
        aggs,
    )

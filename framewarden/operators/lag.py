"""Audio/video offset by cross-correlation, and the series it works on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import abs_difference
from .chunks import CHUNK_ROWS, with_previous

# Audio sample rate, samples per step, analysed stretch in seconds.
SAMPLE_RATE = 22050
HOP_LENGTH = 512
WINDOW_SEC = 60

STEP_MS = HOP_LENGTH / SAMPLE_RATE * 1000.0
WINDOW_STEPS = WINDOW_SEC * SAMPLE_RATE // HOP_LENGTH
#: Steps of a block of the convolution.
BLOCK_STEPS = 128


def max_normalise(df: DataFrame, column: str, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Divide a column by its largest value per file when that is above 0.

    A plain join with one row a file: a file that holds much of the rows is split
    by adaptive execution, whatever its values are.
    """
    top = df.groupBy(*keys).agg(F.max(column).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(F.col(column).cast("double"))
    return df.join(top, list(keys)).withColumn(column, scaled).select(*df.columns)


def motion_energy(pixels: DataFrame, keys: Sequence[str] = ("file_id",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sum of absolute luma change to the previous frame, scaled per file."""
    pairs = with_previous(pixels.select(*keys, "frame_idx", "px"), keys, "frame_idx", {"_prev": "px"}, chunk_rows)
    raw = pairs.where(F.col("_prev").isNotNull()).select(
        *keys, "frame_idx", abs_difference(F.col("px"), F.col("_prev")).alias("energy")
    )
    return max_normalise(raw, "energy", keys)


def _stretch(series: DataFrame, keys: Sequence[str], window: int, tail: bool) -> DataFrame:
    """The first or last ``window`` steps of each file; a file of at most two windows has no tail."""
    if not tail:
        return series.where((F.col("i") >= 0) & (F.col("i") < window))
    last = series.groupBy(*keys).agg(F.max("i").alias("_last"))
    return series.join(last, list(keys)).where(
        (F.col("_last") + 1 > 2 * window) & (F.col("i") > F.col("_last") - window)
    )


def _grid(steps: pa.Array, name: str, width: int) -> np.ndarray:
    """A row of ``width`` values a block, zero where a step is missing."""
    flat = steps.flatten()
    rows = np.repeat(np.arange(len(steps)), np.diff(steps.offsets.to_numpy()))
    out = np.zeros((len(steps), width))
    out[rows, flat.field("at").to_numpy()] = flat.field(name).to_numpy(zero_copy_only=False)
    return out


def _partial_sums(width: int):
    """Correlations of pairs of blocks, as sums for each lag between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, v = _grid(batch.column("_heard"), "a", width), _grid(batch.column("_steps"), "v", width)
            sums = np.zeros((n, 2 * width - 1))
            for step in range(width):
                # Step k of one block meets step k + d of the other.
                sums[:, width - 1 - step : 2 * width - 1 - step] += a[:, step : step + 1] * v
            kept = [c for c in batch.schema.names if c not in ("_heard", "_steps")]
            ends = np.arange(0, n * (2 * width - 1) + 1, 2 * width - 1, dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), listed], names=[*kept, "sums"])

    return run


def xcorr_lag(
    series: DataFrame,
    window: int,
    keys: Sequence[str] = ("file_id",),
    tail: bool = False,
    max_lag: int | None = None,
    scale: bool = False,
) -> DataFrame:
    """Steps by which video follows audio, over the first (or last) ``window`` steps.

    Input: ``keys, i, a, v``; a missing ``i`` counts as silence.  ``window`` is
    the analysed stretch, one minute in the checks (``WINDOW_STEPS``), however
    long a file is.  ``scale`` divides both series by their largest value within
    the stretch.  ``corr`` is the largest correlation, ``lag`` the smallest with it.

    A blocked convolution: both series are cut into blocks; blocks ``i`` and ``j``
    give the lags around ``(j - i)`` blocks, so the work of one file is dealt out
    by pairs of blocks, and their partial sums are added up by lag.
    """
    keys = list(keys)
    part = _stretch(series.select(*keys, "i", F.col("a").cast("double").alias("a"), F.col("v").cast("double").alias("v")), keys, window, tail)
    dense = part.groupBy(*keys, "i").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    # One column holds all of a block, so that its three readers share one shuffle.
    at = F.pmod("i", F.lit(BLOCK_STEPS)).cast("bigint")
    blocks = dense.groupBy(*keys, F.floor(F.col("i") / BLOCK_STEPS).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(at.alias("at"), "a", "v")).alias("_steps")
    )
    edge = lambda name, of: of(F.transform("_steps", lambda s: s[name]))
    first = F.col("_block").cast("bigint") * BLOCK_STEPS
    ends = blocks.groupBy(*keys).agg(
        (F.max(first + edge("at", F.array_max)) - F.min(first + edge("at", F.array_min))).alias("_reach"),
        F.max(edge("a", F.array_max)).alias("_ma"), F.max(edge("v", F.array_max)).alias("_mv"),
    )
    last = (window - 1) // BLOCK_STEPS + 1
    far = last if max_lag is None else min(last, max_lag // BLOCK_STEPS + 1)
    audio = blocks.withColumn("_far", F.explode(F.sequence(F.lit(-far), F.lit(far)))).select(
        *keys, (F.col("_block") + F.col("_far")).alias("_block"), "_far", F.col("_steps").alias("_heard")
    )
    pairs = audio.join(blocks, [*keys, "_block"]).select(*keys, "_far", "_heard", "_steps")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)
    sums = pairs.mapInArrow(_partial_sums(BLOCK_STEPS), f"{kinds}, _far int, sums array<double>")
    lags = sums.select(*keys, "_far", F.posexplode("sums").alias("_at", "part")).select(
        *keys, (F.col("_far") * BLOCK_STEPS + F.col("_at") - (BLOCK_STEPS - 1)).cast("bigint").alias("lag"), "part"
    )
    # Lags where no blocks meet correlate with 0.
    reach = (F.col("_reach") if max_lag is None else F.least("_reach", F.lit(max_lag))).cast("bigint")
    every = ends.select(*keys, F.explode(F.sequence(-reach, reach)).alias("lag"), F.lit(0.0).alias("part"))
    corr = lags.unionByName(every).groupBy(*keys, "lag").agg(F.sum("part").alias("corr"))
    corr = corr.join(ends.select(*keys, reach.alias("_reach"), "_ma", "_mv"), keys).where(F.abs("lag") <= F.col("_reach"))
    best = corr.groupBy(*keys).agg(
        F.max(F.struct("corr", (-F.col("lag")).alias("minus"))).alias("_best"), F.min("_ma").alias("_ma"), F.min("_mv").alias("_mv")
    )
    lag = (-F.col("_best.minus")).cast("long")
    # Scaling divides every lag's sum alike.
    divisor = lambda m: F.when(F.col(m) > 0, F.col(m)).otherwise(1.0)
    top = F.col("_best.corr") / (divisor("_ma") * divisor("_mv")) if scale else F.col("_best.corr")
    return best.select(*keys, lag.alias("lag"), top.alias("corr"), (lag * STEP_MS).alias("offset_ms"))


def head_tail_drift(series: DataFrame, window: int, keys: Sequence[str] = ("file_id",), scale: bool = False) -> DataFrame:
    """Offsets of the first and last ``window`` steps; short files reuse the first."""
    pick = lambda df, end: df.select(
        *keys, F.col("offset_ms").alias(f"offset_{end}_ms"), F.col("corr").alias(f"confidence_{end}")
    )
    head = pick(xcorr_lag(series, window, keys, scale=scale), "head")
    tail = pick(xcorr_lag(series, window, keys, tail=True, scale=scale), "tail").drop("confidence_tail")
    both = head.join(tail, list(keys), "left").withColumn(
        "offset_tail_ms", F.coalesce("offset_tail_ms", "offset_head_ms")
    )
    return both.withColumn("drift_ms", F.col("offset_tail_ms") - F.col("offset_head_ms"))

"""Order-dependent computations that never put a whole file in one task.

A media file can hold a third of all rows, so ``Window.partitionBy(file)`` is
not an option.  Every operator here cuts the file's timeline into fixed-width
chunks and works in two steps:

1. inside ``(keys, chunk)``: ordinary window functions, one task per chunk;
2. across chunks: one summary row per chunk (a map-side combined ``groupBy``),
   whose running total over the earlier chunks is joined back as a carry.

The join and the window share the ``(keys, chunk)`` hash partitioning, so the
rows are shuffled once.  The summary holds one row per chunk; Spark may
broadcast it, but only after adaptive execution has measured it.

Keys must not be null (see :func:`solid_key`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per chunk for dense frame counters, and seconds / microseconds per chunk
# for time-ordered series.
CHUNK_ROWS = 1 << 16
CHUNK_SEC = 600.0
CHUNK_US = 600_000_000

NULL_KEY = "\u0000"


def solid_key(column: str) -> Column:
    """A nullable string key made joinable; undo with :func:`open_key`."""
    return F.coalesce(F.col(column), F.lit(NULL_KEY))


def open_key(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NULL_KEY))


def index_chunk(column: str, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(column) / F.lit(rows)).cast("long")


def time_chunk(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _summarise(op: str, value: Column, order: Sequence[str]) -> Column:
    if op == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"max": F.max, "min": F.min, "sum": F.sum}[op](value)


def _over(op: str, value: Column, window) -> Column:
    if op == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"max": F.max, "min": F.min, "sum": F.sum}[op](value).over(window)


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "last":
        return F.coalesce(local, carry)
    if op == "sum":
        zero = F.lit(0)
        return F.coalesce(carry, zero) + F.coalesce(local, zero)
    return {"max": F.greatest, "min": F.least}[op](carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    specs: dict[str, tuple[str, str]],
    summary_from: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over all *earlier* rows of the same keys.

    ``specs`` maps an output name to ``(op, column)`` with op one of ``max``,
    ``min``, ``sum``, ``last`` (last non-null).  ``order`` must be unique within
    the keys and non-decreasing in ``chunk``.  ``summary_from`` may name a
    cheaper source with the same per-chunk totals; it must hold every chunk.
    """
    parts = [*keys, chunk]
    source = df if summary_from is None else summary_from
    summary = source.groupBy(*parts).agg(
        *[_summarise(op, F.col(c), order).alias(f"_t_{out}") for out, (op, c) in specs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *parts,
        *[_over(op, F.col(f"_t_{out}"), earlier).alias(f"_c_{out}") for out, (op, _) in specs.items()],
    )
    above = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(carry, parts, "left").select(
        *df.columns,
        *[
            _combine(op, F.col(f"_c_{out}"), _over(op, F.col(c), above)).alias(out)
            for out, (op, c) in specs.items()
        ],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    out: str = "frame_idx",
) -> DataFrame:
    """Zero-based position of each row within its keys, counted chunk by chunk."""
    marked = df.withColumn("_chunk", chunk).withColumn("_one", F.lit(1).cast("long"))
    return running(marked, keys, "_chunk", order, {out: ("sum", "_one")}).drop("_chunk", "_one")


def with_previous(
    df: DataFrame, keys: Sequence[str], idx: str, columns: dict[str, str], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add the columns of the row before (new name -> column) in the order of a counter.

    The counter may have holes: the first row of a chunk gets the last row of the
    nearest chunk before it that has one.  Both sides read the same placement, so
    heavy columns such as pixels are shuffled once; one row a chunk meets per key.
    """
    parts = [*keys, "_chunk"]
    placed = df.withColumn("_chunk", index_chunk(idx, chunk_rows))
    w = Window.partitionBy(*parts).orderBy(idx)
    row = F.struct(*[F.col(c).alias(new) for new, c in columns.items()])
    tails = placed.withColumn("_after", F.lead(idx).over(w)).where(F.col("_after").isNull()).select(*parts, row.alias("_tail"))
    following = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
    carry = tails.withColumn("_chunk", following).where(F.col("_chunk").isNotNull())
    first = F.row_number().over(w) == 1
    lagged = placed.withColumns({"_first": first, **{f"_lag_{new}": F.lag(c).over(w) for new, c in columns.items()}})
    return lagged.join(carry, parts, "left").select(
        *df.columns, *[F.when(F.col("_first"), F.col(f"_tail.{new}")).otherwise(F.col(f"_lag_{new}")).alias(new) for new in columns]
    )


def with_lookback(df: DataFrame, ts: str, reach: int, width: int) -> DataFrame:
    """Copy rows within ``reach`` of a chunk's end into the next chunk too.

    Adds ``_chunk`` and ``_own`` (false on the copies); windows over
    ``(keys, _chunk)`` then see everything up to ``reach`` behind each own row.
    """
    if reach > width:
        raise ValueError("look-back must not exceed the chunk width")
    at = F.col(ts)
    inside = F.pmod(at, F.lit(width))
    copies = F.when(
        inside >= width - reach, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_chunk", time_chunk(ts, width) + F.col("_copy"))
        .withColumn("_own", F.col("_copy") == 0)
        .drop("_copy")
    )

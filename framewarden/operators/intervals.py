"""Interval operators: stitching, overlap tests, start/end pairing, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, CHUNK_SEC, index_chunk, open_key, running, solid_key, time_chunk


def fold_details(items: Column) -> Column:
    """Join texts with `` | `` in order, leaving out any already contained."""
    text = F.transform(items, lambda e: F.coalesce(e["details"], F.lit("")))
    return F.aggregate(
        F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0))),
        text[0],
        lambda acc, d: F.when(F.contains(acc, d), acc).otherwise(F.concat(acc, F.lit(" | "), d)),
    )


@dataclass(frozen=True)
class Stitched:
    """``islands``: one numeric row per merged event; ``texts``: its distinct texts as rows, numbered by ``at``."""

    islands: DataFrame
    texts: DataFrame


def stitch_islands(
    events: DataFrame,
    tolerance: float = 0.1,
    keys: Sequence[str] = ("file_id",),
    carry: Sequence[str] = ("severity",),
    width: float = CHUNK_SEC,
) -> Stitched:
    """Merge events of one type that overlap or follow within ``tolerance``.

    Input: ``keys, ord, type, start_time, end_time, details`` and the ``carry``
    columns, which come from the first event of each merged one.  Missing times
    count as 0.  An island is named by its first row: ``keys``, ``type`` and the
    ``start_time`` and ``ord`` of that row.

    Rows that differ only in ``ord`` and end are combined before the shuffle.
    Rows whose end lies before ``start - tolerance`` cannot be joined to by a row
    with the same start and are kept apart by ``ord``.  What goes on from chunk to
    chunk is settled on numbers, at most two rows a chunk; texts are rows
    throughout and only look up the name of their island.
    """
    keys, carry = list(keys), list(carry)
    full = [*keys, "_type"]
    base = events.select(
        *keys,
        solid_key("type").alias("_type"),
        "ord",
        F.coalesce("start_time", F.lit(0.0)).alias("start_time"),
        F.coalesce("end_time", F.lit(0.0)).alias("end_time"),
        "details",
        *carry,
    ).withColumn("_chunk", time_chunk("start_time", width))
    lone = F.when(F.col("end_time") < F.col("start_time") - tolerance, F.col("ord"))
    rows = (
        base.withColumn("_lone", lone)
        .groupBy(*full, "_chunk", "start_time", "_lone", "details", *carry)
        .agg(F.min("ord").alias("ord"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("n_events"))
        .drop("_lone")
    )
    reach = running(
        rows, full, "_chunk", ["start_time", "ord"], {"_reach": ("max", "end_time")}, summary_from=base
    )
    opens = F.col("_reach").isNull() | (F.col("start_time") > F.col("_reach") + tolerance)
    in_order = Window.partitionBy(*full, "_chunk").orderBy("start_time", "ord").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # Head of the latest island opened in this chunk; none yet means that an
    # island of an earlier chunk goes on.
    head = {f"_h_{c}": c for c in ("start_time", "ord")}
    first = {f"_f_{c}": c for c in carry}
    marked = reach.withColumn("_opens", opens).select(
        *full, "_chunk", "end_time", "details", "n_events",
        F.row_number().over(in_order).alias("_rn"),
        F.last(F.when(F.col("_opens"), F.struct(*head.values(), *carry)), ignorenulls=True).over(in_order).alias("_h"),
    )
    placed = marked.select("*", *[F.col(f"_h.{c}").alias(n) for n, c in {**head, **first}.items()])
    pieces = placed.groupBy(*full, "_chunk", *head, *first).agg(
        F.max("end_time").alias("end_time"), F.sum("n_events").alias("n_events")
    )
    # Pieces that continue an island, and each chunk's last island, which may be
    # continued, meet per file; the rest is final.
    local = Window.partitionBy(*full, "_chunk")
    top = F.max(F.struct("_h_start_time", "_h_ord")).over(local)
    edge = F.col("_h_ord").isNull() | (F.struct("_h_start_time", "_h_ord") == F.col("_top"))
    slotted = pieces.withColumn("_top", top).withColumn(
        "_slot", F.when(edge, F.lit(-1).cast("long")).otherwise(F.col("_chunk"))
    )
    # Continuations (no head) come first in their chunk and take the head before.
    w = Window.partitionBy(*full, "_slot").orderBy("_chunk", F.asc_nulls_first("_h_start_time"), F.asc_nulls_first("_h_ord"))
    named = F.struct(*head, *first)
    carried = slotted.withColumn("_h", F.last(F.when(F.col("_h_ord").isNotNull(), named), ignorenulls=True).over(w)).withColumn(
        "_goes_on", F.col("_h_ord").isNull()
    )
    merged = carried.select(
        *full, "_slot", "_chunk", "_goes_on", "end_time", "n_events", *[F.col(f"_h.{n}").alias(n) for n in (*head, *first)]
    )
    islands = merged.groupBy(*full, "_slot", *head, *first).agg(F.max("end_time").alias("end_time"), F.sum("n_events").alias("n_events"))
    name = [*keys, open_key("_type").alias("type"), F.col("_h_start_time").alias("start_time"), F.col("_h_ord").alias("ord")]
    numbers = islands.select(*name, "end_time", *[F.col(f"_f_{c}").alias(c) for c in carry], "n_events")
    # Texts: those of a continued island take its name, the others have theirs.
    at = (F.col("_chunk").cast("decimal(38,0)") * (1 << 40) + F.col("_rn")).alias("at")
    texts = placed.groupBy(*full, "_chunk", *head, "details").agg(F.min("_rn").alias("_rn"))
    going_on = merged.where("_goes_on").select(*full, "_chunk", *head)
    lines = texts.where(F.col("_h_ord").isNotNull()).select(*full, *head, "details", at).unionByName(
        texts.where(F.col("_h_ord").isNull()).drop(*head).join(going_on, [*full, "_chunk"]).select(*full, *head, "details", at)
    )
    lines = lines.groupBy(*full, *head, "details").agg(F.min("at").alias("at"))
    return Stitched(numbers, lines.select(*name, "at", "details"))


def stitch_events(
    events: DataFrame,
    tolerance: float = 0.1,
    keys: Sequence[str] = ("file_id",),
    carry: Sequence[str] = ("severity",),
    width: float = CHUNK_SEC,
) -> DataFrame:
    """Merged events with their texts folded into one ``details`` cell.

    One row per merged event with ``n_events``.  The cell joins the distinct texts
    of the events, so it suits timelines whose events share few texts; where each
    has its own, take ``stitch_islands`` and leave the texts as rows.
    """
    both = stitch_islands(events, tolerance, keys, carry, width)
    name = [*keys, "_t", "start_time", "ord"]
    folded = both.texts.withColumn("_t", solid_key("type")).groupBy(*name).agg(
        fold_details(F.array_sort(F.collect_list(F.struct("at", "details")))).alias("details")
    )
    return both.islands.withColumn("_t", solid_key("type")).join(folded, name).select(
        *keys, "type", "start_time", "end_time", *carry, "details", "n_events", "ord"
    )


def overlap_anti_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
    width: float = CHUNK_SEC,
) -> DataFrame:
    """Rows of ``left`` that overlap no ``right`` interval of the same keys.

    Overlap is strict: ``l.start < r.end and l.end > r.start``.  No pairs are
    formed: among right intervals that start before ``l.end``, only the furthest
    end matters, and that is a running maximum.
    """
    keys = list(keys)
    walls = right.groupBy(*keys, F.col(start).alias("_pos")).agg(F.max(end).alias("_reach"))
    asks = left.select(*keys, F.col(end).alias("_pos")).distinct()
    # At equal positions the question comes first: r.start < l.end is strict.
    line = (
        asks.select(*keys, "_pos", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_reach"))
        .unionByName(walls.select(*keys, "_pos", F.lit(1).alias("_kind"), "_reach"))
        .withColumn("_chunk", time_chunk("_pos", width))
    )
    # Chunk totals straight from the intervals, combined on the map side.
    raw = right.select(*keys, time_chunk(start, width).alias("_chunk"), F.col(end).alias("_reach")).unionByName(
        left.select(*keys, time_chunk(end, width).alias("_chunk"), F.lit(None).cast("double").alias("_reach"))
    )
    seen = running(line, keys, "_chunk", ["_pos", "_kind"], {"_seen": ("max", "_reach")}, summary_from=raw)
    answers = seen.where(F.col("_kind") == 0).select(*keys, F.col("_pos").alias(end), "_seen")
    return (
        left.join(answers, [*keys, end], "left")
        .where(F.col("_seen").isNull() | (F.col("_seen") <= F.col(start)))
        .select(*left.columns)
    )


def pair_start_end(
    tokens: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Match each end with the latest unmatched start before it (last in, first out).

    Input: ``keys, line_no, kind ('start'|'end'), at``.  The nesting depth is the
    running sum of +1/-1 above its running minimum; an end with nothing open is
    dropped.  At one depth starts and ends alternate, so the partner is simply
    the previous token of that depth.
    """
    keys = list(keys)
    parts = [*keys, "_chunk"]
    step = F.when(F.col("kind") == "start", F.lit(1)).otherwise(F.lit(-1)).cast("long")
    in_order = Window.partitionBy(*parts).orderBy("line_no")
    line = (
        tokens.withColumn("_step", step)
        .withColumn("_chunk", index_chunk("line_no", chunk_rows))
        .withColumn("_sum", F.sum("_step").over(in_order))
    )
    # Sum and lowest sum of each chunk give what the chunks before it left open.
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        line.groupBy(*parts)
        .agg(F.sum("_step").alias("_t"), F.min("_sum").alias("_m"))
        .withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_base") + F.col("_m")).over(earlier))
        .select(*parts, "_base", "_floor")
    )
    above = in_order.rowsBetween(Window.unboundedPreceding, -1)
    low = (
        line.withColumn("_min", F.min("_sum").over(above))
        .join(carry, parts)
        .withColumn("_low", F.least(F.lit(0), F.col("_floor"), F.col("_base") + F.col("_min")))
        .withColumn("_sum", F.col("_base") + F.col("_sum"))
    )
    is_start = F.col("kind") == "start"
    leveled = low.where(is_start | (F.col("_sum") >= F.col("_low"))).withColumn(
        "_level", F.col("_sum") - F.col("_low") + F.when(is_start, 0).otherwise(1)
    )
    w = Window.partitionBy(*keys, "_level", "_chunk").orderBy("line_no")
    edge = ((F.lag("line_no").over(w).isNull()) & ~is_start) | ((F.lead("line_no").over(w).isNull()) & is_start)
    slotted = leveled.withColumn("_slot", F.when(edge, F.lit(-1).cast("long")).otherwise(F.col("_chunk")))
    w2 = Window.partitionBy(*keys, "_level", "_slot").orderBy("line_no")
    return (
        slotted.withColumn("start_time", F.lag("at").over(w2))
        .where(~is_start)
        .select(*keys, "line_no", "start_time", F.col("at").alias("end_time"))
    )


def severity_heatmap(events: DataFrame, keys: Sequence[str] = ("file_id",), bins_per_chunk: int = 4096) -> DataFrame:
    """Highest ``max(1, severity_score)`` covering each whole second.

    Input: ``keys, start_time, end_time, severity_score``, any whole scores.  Every
    event adds +1 at its first bin and -1 after its last one; the running sum of a
    score gives the stretches it covers, however many events overlap there.  A
    second is then written once for each distinct score that covers it.
    """
    keys = list(keys)
    top = events.groupBy(*keys).agg(F.max("end_time").alias("_max")).select(
        *keys, (F.when(F.col("_max") <= 0, F.lit(10.0)).otherwise(F.col("_max"))).cast("long").alias("_last")
    )
    first, last = F.greatest(F.lit(0), F.col("start_time").cast("long")), F.greatest(F.lit(0), F.col("end_time").cast("long"))
    scored = events.select(*keys, F.greatest(F.lit(1), F.col("severity_score")).alias("_score"), first.alias("_a"), last.alias("_b"))
    mark = lambda at, d: F.struct(at.alias("bin"), F.lit(d).cast("long").alias("d"))
    marks = scored.where("_a <= _b").select(*keys, "_score", F.explode(F.array(mark(F.col("_a"), 1), mark(F.col("_b") + 1, -1))).alias("_m"))
    deltas = marks.groupBy(*keys, "_score", F.col("_m.bin").alias("bin")).agg(F.sum("_m.d").alias("d"))
    line = deltas.withColumn("_chunk", index_chunk("bin", bins_per_chunk))
    # What is open before a change, and since which change.
    before = running(line, [*keys, "_score"], "_chunk", ["bin"], {"_open": ("sum", "d"), "_from": ("last", "bin")})
    cover = before.where(F.col("_open") > 0).select(*keys, "_score", F.col("_from").alias("_a"), (F.col("bin") - 1).alias("_b"))
    # Ends before it starts: counts only where both are cut back to the last second.
    turned = scored.where("_a > _b").join(top, keys).where("_b = _last").select(*keys, "_score", F.col("_b").alias("_a"), "_b")
    spans = cover.union(turned).unionByName(top.select(*keys, F.lit(0).alias("_score"), F.lit(0).cast("long").alias("_a"), F.col("_last").alias("_b")))
    cut = spans.join(top, keys).select(*keys, "_score", "_a", F.least("_b", "_last").alias("_b")).where("_a <= _b")
    parts = cut.select(*keys, "_score", "_a", "_b", F.explode(F.sequence(F.floor(F.col("_a") / bins_per_chunk), F.floor(F.col("_b") / bins_per_chunk))).alias("_k"))
    seconds = parts.select(
        *keys, "_score",
        F.explode(F.sequence(F.greatest("_a", F.col("_k") * bins_per_chunk), F.least("_b", F.col("_k") * bins_per_chunk + (bins_per_chunk - 1)))).alias("bin"),
    )
    return seconds.groupBy(*keys, "bin").agg(F.max("_score").alias("level"))

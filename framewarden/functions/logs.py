"""Numbers and findings pulled out of tool log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timecode import clock_to_seconds

BLANKS = " \t\r\n\f\u000b"

# Decoder complaints, matched without regard to case.
ERROR_PATTERNS = {
    "non_monotonic_dts": r"DTS .* < .*",
    "non_monotonic_pts": r"PTS .* < .*",
    "timestamp_discontinuity": r"Timestamp discontinuity",
    "corrupt_packet": r"corrupt decoded frame",
}


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("double")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse_silence(logs: DataFrame) -> DataFrame:
    """Silent stretches: adds ``start, end``; unreadable lines are skipped."""
    line = F.col("line")
    pattern = r"silence_end:\s*([^\s|]+)\s*\|\s*silence_duration:\s*(\S+)"
    end, length = _number(line, pattern, 1), _number(line, pattern, 2)
    return (
        logs.where(F.contains(line, F.lit("silence_end")))
        .withColumns({"start": F.round(end - length, 2), "end": F.round(end, 2)})
        .where(F.col("start").isNotNull())
        .drop("line")
    )


def parse_black(logs: DataFrame) -> DataFrame:
    line = F.col("line")
    return (
        logs.where(F.contains(line, F.lit("black_start")))
        .withColumns(
            {
                "start_time": _number(line, r"black_start:([-0-9.]+)"),
                "end_time": _number(line, r"black_end:([-0-9.]+)"),
                "duration": _number(line, r"black_duration:([-0-9.]+)"),
            }
        )
        .where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
        .drop("line")
    )


def parse_freeze(logs: DataFrame) -> DataFrame:
    """Freeze start and end marks as ``kind, at``."""
    line = F.col("line")
    pattern = r"lavfi\.freezedetect\.freeze_(start|end): *([-0-9.]+)"
    return (
        logs.where(F.contains(line, F.lit("lavfi.freezedetect.freeze_")))
        .withColumns({"kind": F.regexp_extract(line, pattern, 1), "at": _number(line, pattern, 2)})
        .where(F.col("at").isNotNull())
        .drop("line")
    )


def parse_loudness_summary(logs: DataFrame) -> DataFrame:
    """Last integrated loudness, range and peak per file.

    Missing values keep the measuring tool's blanks: -99, 0 and -99.
    """
    line = strip(F.col("line"))
    lufs = F.when(line.rlike("^I:.*LUFS"), F.btrim(F.regexp_extract(line, "^I:(.*?)LUFS", 1)).try_cast("double"))
    lra = F.when(line.rlike("^LRA:.*LU"), F.btrim(F.regexp_extract(line, "^LRA:(.*?)LU", 1)).try_cast("double"))
    peak = line_peak(line)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return logs.groupBy("file_id").agg(
        F.coalesce(last(lufs), F.lit(-99.0)).alias("integrated_lufs"),
        F.coalesce(last(lra), F.lit(0.0)).alias("lra"),
        F.coalesce(last(peak), F.lit(-99.0)).alias("true_peak"),
    )


def line_peak(line: Column) -> Column:
    """Highest channel on a ``True peak:`` line; words that are no numbers are skipped."""
    words = F.split(F.btrim(F.regexp_extract(line, "^True peak:(.*?)dBTP", 1)), r"\s+")
    return F.when(line.rlike("^True peak:.*dBTP"), F.array_max(F.transform(words, lambda w: w.try_cast("double"))))


def astats_values(line: Column) -> dict[str, Column]:
    after = lambda mark: F.when(
        F.contains(line, F.lit(mark)), F.btrim(F.get(F.split(line, "="), 1)).try_cast("double")
    )
    return {
        "dc_offset": after("lavfi.astats.Overall.DC_offset"),
        "dynamic_range": after("lavfi.astats.Overall.Dynamic_range"),
        "max_volume": _number(line, r"max_volume:\s*([-0-9.]+)\s*dB"),
    }


def parse_astats(logs: DataFrame) -> DataFrame:
    values = astats_values(F.col("line"))
    return (
        logs.withColumns(values)
        .where(F.coalesce(*[F.col(c) for c in values]).isNotNull())
        .drop("line")
    )


def log_errors(logs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One event per line and matching complaint; ``max_chars`` asks for a short form of the text."""
    line = F.col("line")
    found = F.array_compact(F.array(*[F.when(line.rlike("(?i)" + p), F.lit(n)) for n, p in ERROR_PATTERNS.items()]))
    at = clock_to_seconds(line)
    return logs.select(
        "file_id", "line_no",
        F.explode(found).alias("type"),
        (strip(line) if max_chars is None else F.substring(strip(line), 1, max_chars)).alias("details"),
        at.alias("start_time"), at.alias("end_time"),
    )


def cap_per_type(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` events of each type in line order.

    Spark limits each map task's groups before the shuffle (window group limit),
    so a hot file sends at most ``most`` rows per task and type.
    """
    w = Window.partitionBy("file_id", "type").orderBy("line_no")
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


LOUDNORM_FIELDS = ("input_i", "input_tp", "input_lra", "input_thresh")


def parse_loudnorm(docs: DataFrame, text: str = "log") -> DataFrame:
    """Measured values from the JSON between the last ``{`` and the last ``}`` of each log.

    Numbers arrive as strings; logs without such a block are left out.  Each step
    passes through explode, which keeps it from being repeated per field.
    """
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    n = F.length(text)
    ends = docs.withColumns({"_l": F.instr(F.reverse(text), "{"), "_r": F.instr(F.reverse(text), "}")}).where(
        (F.col("_r") > 0) & (F.col("_r") < F.col("_l"))
    )
    block = F.substr(F.col(text), n - F.col("_l") + 1, F.col("_l") - F.col("_r") + 1)
    raw = F.from_json("_block", "struct<" + ",".join(f"{f}:string" for f in LOUDNORM_FIELDS) + ">")
    parsed = once(once(ends, "_block", block), "_m", raw).where(F.col("_m").isNotNull())
    return parsed.select("file_id", *[F.col(f"_m.{f}").try_cast("double").alias(f) for f in LOUDNORM_FIELDS])


def parse_progress(logs: DataFrame) -> DataFrame:
    """Latest percentage and latest named step per job."""
    pattern = r"\[PROGRESS\]\s+(\d+)(?:\s+-\s+(.*))?"
    pct = F.regexp_extract("line", pattern, 1).try_cast("int")
    step = F.nullif(F.regexp_extract("line", pattern, 2), F.lit(""))
    return (
        logs.withColumns({"pct": pct, "step": step})
        .where(F.col("pct").isNotNull())
        .groupBy("job_id")
        .agg(
            F.max_by("pct", "line_no").alias("progress"),
            F.max_by("step", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("current_step"),
        )
    )


def last_crop(logs: DataFrame) -> DataFrame:
    """Last active picture area per file from ``crop=w:h:x:y`` marks."""
    line = F.col("line")
    last = F.element_at(F.regexp_extract_all(line, F.lit(r"(crop=\d+:\d+:\d+:\d+)"), 1), -1)
    parts = F.split(F.substr(last, F.lit(6)), ":")
    area = F.struct(*[F.get(parts, i).try_cast("int").alias(c) for i, c in enumerate(("w", "h", "x", "y"))])
    return (
        logs.where(line.rlike(r"crop=\d+:\d+:\d+:\d+"))
        .groupBy("file_id")
        .agg(F.max_by(area, "line_no").alias("_a"))
        .select("file_id", "_a.w", "_a.h", "_a.x", "_a.y")
    )

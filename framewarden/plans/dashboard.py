"""Tables behind the dashboard, calibration and grading reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logs import last_crop
from ..functions.wording import display_duration
from ..operators.events import describe_events, issue_summary, normalize_event_time
from ..operators.frames import field_metrics
from ..operators.grading import calibration_signal, grade_cases, system_accuracy
from ..operators.intervals import severity_heatmap


def dashboard_tables(events: DataFrame) -> dict[str, DataFrame]:
    """``timeline`` (bars), ``issues`` (summary) and ``heatmap`` of each file."""
    described = describe_events(normalize_event_time(events))
    bars = described.withColumn("viz_duration", display_duration(F.col("start_time"), F.col("end_time")))
    return {"timeline": bars, "issues": issue_summary(described), "heatmap": severity_heatmap(described)}


def calibration_report(frames: DataFrame, pixels: DataFrame, logs: DataFrame) -> DataFrame:
    """Signal, field and geometry measurements side by side, one row per file."""
    signal = calibration_signal(frames)
    fields = field_metrics(pixels).drop("frames")
    return signal.join(fields, "file_id", "full").join(last_crop(logs), "file_id", "full")


def benchmark_grade(plan: DataFrame, results: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    graded = grade_cases(plan, results, found)
    return graded, system_accuracy(graded)

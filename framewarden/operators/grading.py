"""Grading of detection runs and calibration of score thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grade_cases(plan: DataFrame, results: DataFrame, found: DataFrame) -> DataFrame:
    """PASS or FAIL per planned case.

    ``plan``: ``name, expect_status ARRAY, expect_event ARRAY`` (empty = clean);
    ``results``: ``name, status``; ``found``: ``name, type`` per event.  A keyword
    matches any type containing it.  A clean case with one event, a sync one, is
    forgiven; a case without result fails.
    """
    types = found.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    wanted = plan.select("name", F.explode("expect_event").alias("word"))
    matched = (
        wanted.join(types, "name").where(F.contains("type", F.col("word"))).select("name").distinct()
        .withColumn("matched", F.lit(True))
    )
    totals = types.groupBy("name").agg(
        F.sum("n").alias("n_events"), F.bool_or(F.contains("type", F.lit("avsync"))).alias("sync")
    )
    clean = F.size("expect_event") == 0
    only_sync = clean & (F.coalesce("n_events", F.lit(0)) == 1) & F.coalesce("sync", F.lit(False))
    status_ok = F.array_contains("expect_status", F.col("status")) | only_sync
    event_ok = clean | F.coalesce("matched", F.lit(False))
    passed = F.col("status").isNotNull() & status_ok & event_ok
    return (
        plan.join(results, "name", "left").join(matched, "name", "left").join(totals, "name", "left")
        .select("name", "status", F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL").alias("grade"))
    )


def system_accuracy(graded: DataFrame) -> DataFrame:
    return graded.agg(
        F.count(F.lit(1)).alias("cases"),
        (F.count_if(F.col("grade") == "PASS") * 100 / F.count(F.lit(1))).alias("accuracy_pct"),
    )


def tier_from_name(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for tier in ("high", "medium", "low"):
        hit = F.contains(low, F.lit(tier))
        out = F.when(hit, tier.upper()) if out is None else out.when(hit, tier.upper())
    return out.otherwise("UNKNOWN")


def quality_tier_stats(scores: DataFrame) -> DataFrame:
    """Count, extremes, mean and population spread of each quality tier."""
    mean = F.avg("score")
    verdict = (
        F.when(F.col("tier") == "HIGH", F.when(F.col("mean") < 45, "PASS").otherwise("HIGH"))
        .when(F.col("tier") == "MEDIUM", F.when(F.col("mean").between(30, 65), "PASS").otherwise("DEVIATION"))
        .otherwise(F.when(F.col("mean") > 55, "PASS").otherwise("LOW"))
    )
    return (
        scores.withColumn("tier", tier_from_name(F.col("frame_name")))
        .where(F.col("tier") != "UNKNOWN")
        .groupBy("tier")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
            mean.alias("mean"), F.stddev_pop("score").alias("std"),
        )
        .withColumn("verdict", verdict)
    )


def recommend_threshold(tiers: DataFrame, default: float = 55.0) -> DataFrame:
    """Midway between the MEDIUM and LOW means; the default if either is missing or 0."""
    mean = lambda t: F.max(F.when((F.col("tier") == t) & (F.col("mean") != 0), F.col("mean")))
    return tiers.agg(
        F.coalesce((mean("MEDIUM") + mean("LOW")) / 2, F.lit(default)).alias("recommended_threshold")
    )


def calibration_signal(frames: DataFrame, keys=("file_id",), spike: float = 5.0) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_processed"),
        F.coalesce(F.max("vrep"), F.lit(0.0)).alias("vrep_max"),
        F.coalesce(F.avg("vrep"), F.lit(0.0)).alias("vrep_mean"),
        F.count_if(F.col("vrep") > spike).alias("vrep_spike_count"),
        F.coalesce(F.min("ymin"), F.lit(255)).alias("ymin_min"),
        F.coalesce(F.max("ymax"), F.lit(0)).alias("ymax_max"),
    )

"""Queries over the job table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id")


def pending_jobs(jobs: DataFrame) -> DataFrame:
    """Queued analyses, then queued repairs; a job in both appears twice."""
    pick = lambda cond, kind: jobs.where(cond).withColumn("queue", F.lit(kind))
    return pick(F.col("status") == "QUEUED", "analysis").unionByName(pick(F.col("fix_status") == "QUEUED", "repair"))


def job_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each job with its report by path; not ready while there is none."""
    return jobs.join(reports, jobs["result_path"] == reports["path"], "left").select(
        "id", "result_path", "overall_status", F.col("path").isNotNull().alias("ready")
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "COMPLETED")
    total = F.count(F.lit(1))
    return jobs.agg(
        total.alias("total"), done.alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0)).alias("pass_rate"),
    )

"""Overlap, pairing, lag and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators.grading import grade_cases
from ..operators.intervals import overlap_anti_join, pair_start_end
from ..operators.jobs import job_reports
from ..operators.lag import HOP_LENGTH, SAMPLE_RATE, WINDOW_STEPS, head_tail_drift, xcorr_lag
from ..operators.segments import join_segment_offset
from . import query


def sides(silences: DataFrame) -> tuple[DataFrame, DataFrame]:
    return silences.where(F.col("type") == "view"), silences.where(F.col("type") == "error")


@query(
    "phase_cancellation", "silences",
    sql="""select file_id, 'phase_inversion_detected' as type, start as start_time, "end" as end_time, 'CRITICAL' as severity
       from silences m where type = 'view' and not exists (select 1 from silences s where s.type = 'error' and s.file_id = m.file_id
         and m.start < s."end" and m."end" > s.start)""",
)
def phase_cancellation(silences):
    mono, source = sides(silences)
    return overlap_anti_join(mono, source, ["file_id"]).select(
        "file_id", F.lit("phase_inversion_detected").alias("type"), F.col("start").alias("start_time"),
        F.col("end").alias("end_time"), F.lit("CRITICAL").alias("severity"),
    )


PAIRED_SQL = """
s as (select *, sum(case kind when 'start' then 1 else -1 end) over (partition by file_id order by line_no rows unbounded preceding) as s from freeze_tokens),
m as (select *, least(0, coalesce(min(s) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding), 0)) as m from s),
l as (select *, s - m + case kind when 'start' then 0 else 1 end as level from m where kind = 'start' or s >= m),
p as (select *, lag("at") over (partition by file_id, level order by line_no) as start_time from l),
paired as (select file_id, line_no, start_time, "at" as end_time from p where kind = 'end')
"""


@query("pair_freeze", "freeze_tokens", sql=f"with {PAIRED_SQL} select * from paired")
def pair_freeze(tokens):
    return pair_start_end(tokens, ["file_id"])


def hourly(base: DataFrame) -> DataFrame:
    """One step per hour: audio from clicks, video from views."""
    total = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("cents")).otherwise(0))
    return base.groupBy("file_id", F.floor(F.col("us") / 3600000000).alias("i")).agg(
        total("click").alias("a"), total("view").alias("v")
    )


SERIES_SQL = """h as (select file_id, us // 3600000000 as i, sum(case event_type when 'click' then cents else 0 end) as a,
  sum(case event_type when 'view' then cents else 0 end) as v from qc_base group by 1, 2)"""


def _lag_sql(source: str) -> str:
    return f"""select x.file_id, y.i - x.i as lag, cast(sum(x.a * y.v) as double) as corr
       from {source} x join {source} y on y.file_id = x.file_id group by 1, 2"""


def _best_sql(source: str, name: str) -> str:
    return f"""{name} as (select file_id, arg_max(lag, (corr, -lag)) as lag, max(corr) as corr from ({_lag_sql(source)}) t group by 1)"""


STEP_SQL = f"{HOP_LENGTH}.0e0 / {SAMPLE_RATE} * 1000"


@query(
    "xcorr_lag", "qc_base",
    sql=f"""with {SERIES_SQL}, w as (select * from h where i >= 0 and i < {WINDOW_STEPS}), {_best_sql('w', 'b')}
       select file_id, lag, corr, round(lag * ({STEP_SQL}), 3) as offset_ms from b""",
)
def xcorr(base):
    best = xcorr_lag(hourly(base), WINDOW_STEPS)
    return best.select("file_id", "lag", "corr", F.round("offset_ms", 3).alias("offset_ms"))


@query(
    "head_tail_drift", "qc_base",
    sql=f"""with {SERIES_SQL}, e as (select file_id, max(i) as last from h group by 1),
       head as (select * from h where i >= 0 and i < 240),
       tail as (select h.* from h join e on e.file_id = h.file_id where last + 1 > 480 and h.i > last - 240),
       {_best_sql('head', 'bh')}, {_best_sql('tail', 'bt')}
       select bh.file_id, round(bh.lag * ({STEP_SQL}), 3) as offset_head_ms,
         round(coalesce(bt.lag, bh.lag) * ({STEP_SQL}), 3) as offset_tail_ms,
         round(coalesce(bt.lag, bh.lag) * ({STEP_SQL}) - bh.lag * ({STEP_SQL}), 3) as drift_ms, bh.corr as confidence_head
       from bh left join bt on bt.file_id = bh.file_id""",
)
def drift(base):
    both = head_tail_drift(hourly(base), window=240)
    return both.select(
        "file_id", *[F.round(c, 3).alias(c) for c in ("offset_head_ms", "offset_tail_ms", "drift_ms")], "confidence_head"
    )


@query(
    "join_segment_offset", "segment_events",
    sql="select file_id, ord, segment_id, segment_start, segment_start + start_time as absolute_start from segment_events",
)
def segment_offset(events):
    segments = events.select("file_id", "segment_id", F.col("segment_start").alias("start_time")).distinct()
    joined = join_segment_offset(events.drop("segment_start"), segments)
    return joined.select(
        "file_id", "ord", "segment_id", "segment_start", (F.col("segment_start") + F.col("start_time")).alias("absolute_start")
    )


def cases(plan: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned cases, and a verdict for those whose run left events."""
    status = F.when(F.col("want_rejected"), F.array(F.lit("REJECTED"), F.lit("WARNING"))).otherwise(
        F.array(F.lit("PASSED"), F.lit("WARNING"))
    )
    word = F.array(F.col("keyword"))
    planned = plan.select(
        "name", status.alias("expect_status"), F.when(F.col("clean"), F.slice(word, 1, 0)).otherwise(word).alias("expect_event")
    )
    top = F.max("k")
    verdict = F.when(top >= 90, "REJECTED").when(top >= 60, "WARNING").otherwise("PASSED")
    return planned, found.groupBy("name").agg(verdict.alias("status"))


GRADE_SQL = """r as (select name, case when max(k) >= 90 then 'REJECTED' when max(k) >= 60 then 'WARNING' else 'PASSED' end as status,
  count(*) as n, bool_or(contains(type, 'avsync')) as sync, list(type) as types from found_types group by 1),
g as (select p.name, r.status, case when r.status is not null
   and (case when p.want_rejected then r.status in ('REJECTED', 'WARNING') else r.status in ('PASSED', 'WARNING') end
        or (p.clean and r.n = 1 and r.sync))
   and (p.clean or len(list_filter(r.types, lambda t: contains(t, p.keyword))) > 0) then 'PASS' else 'FAIL' end as grade
  from test_plan p left join r on r.name = p.name)"""


@query("grade_cases", "test_plan", "found_types", sql=f"with {GRADE_SQL} select name, status, grade from g")
def grade(plan, found):
    planned, results = cases(plan, found)
    return grade_cases(planned, results, found)


@query(
    "job_reports", "jobs", "report_paths",
    sql="""select id, result_path, overall_status, path is not null as ready from jobs left join report_paths on path = result_path""",
)
def jobs_with_reports(jobs, reports):
    return job_reports(jobs, reports)

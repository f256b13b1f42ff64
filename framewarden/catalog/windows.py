"""Interval merging, bursts, runs and scaling along the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.quality import classify_severity
from ..operators import frames as fr
from ..operators.density import broadcast_bursts
from ..operators.intervals import stitch_events, stitch_islands
from ..operators.lag import max_normalise, motion_energy
from . import query
from .aggregates import DUP_SQL, marked
from .joins import hourly


def stitched_sql(source: str, name: str = "stitched") -> str:
    return f"""{name}_m as (select *, max(end_time) over (partition by file_id, type order by start_time, ord rows between unbounded preceding and 1 preceding) as reach from {source}),
 {name}_i as (select *, sum(case when reach is null or start_time > reach + 0.1e0 then 1 else 0 end) over (partition by file_id, type order by start_time, ord rows unbounded preceding) as isl from {name}_m),
 {name} as (select file_id, type, min(start_time) as start_time, max(end_time) as end_time, count(*) as n_events, arg_min(severity, (start_time, ord)) as severity,
   list_reduce(list(details order by start_time, ord), lambda a, x: case when contains(a, x) then a else concat(a, ' | ', x) end) as details
   from {name}_i group by file_id, type, isl)"""


STITCHED_COLUMNS = ("file_id", "type", "start_time", "end_time", "severity", "details", "n_events")
STITCHED_SQL = stitched_sql("timeline")


@query("stitch_events", "timeline", sql=f"with {STITCHED_SQL} select {', '.join(STITCHED_COLUMNS)} from stitched")
def stitch(timeline):
    return stitch_events(timeline).select(*STITCHED_COLUMNS)


@query(
    "stitch_texts", "timeline",
    sql=f"""with own as (select * replace (concat(details, ' of ', cast(ord as varchar)) as details) from timeline), {stitched_sql('own', 't')}
       select file_id, type, min(start_time) over (partition by file_id, type, isl) as start_time,
         first_value(ord) over (partition by file_id, type, isl order by start_time, ord) as ord, details from t_i""",
)
def stitch_texts(timeline):
    """Texts of merged events as rows, with a text of its own for every event."""
    own = timeline.withColumn("details", F.concat("details", F.lit(" of "), F.col("ord").cast("string")))
    return stitch_islands(own).texts.select("file_id", "type", "start_time", "ord", "details")


def ml_sql(source: str, extra: str = "1.0e0") -> str:
    return f"""dirty as (select * from {source} where severity <> 'CLEAN'),
 g as (select *, case when ts - lag(ts) over (partition by file_id order by ts, ord) <= 1.5e0 then 0 else 1 end as new from dirty),
 i as (select *, sum(new) over (partition by file_id order by ts, ord rows unbounded preceding) as isl from g),
 e as (select file_id, min(ts) as start_time, max(ts) as end_time, case when bool_or(severity = 'SEVERE') then 'SEVERE' else arg_min(severity, (ts, ord)) end as severity,
   count(*) as n_frames, cast(sum(cast(round(score * 100) as bigint)) as bigint) / (count(*) * 100) as avg_score, max(score) as peak_score from i group by file_id, isl),
 ml as (select * from e where end_time - start_time >= {extra} or severity = 'SEVERE')"""


BAND_SQL = """case when score < 0 then 'UNKNOWN' when score >= 75 then 'SEVERE' when score >= 55 then 'MODERATE' when score >= 35 then 'MILD' else 'CLEAN' end"""
ML_COLUMNS = ("file_id", "start_time", "end_time", "severity", "n_frames", "avg_score", "peak_score")


@query(
    "stitch_ml_events", "frame_scores",
    sql=f"""with sc as (select file_id % 5 * 1000 + ord % 40 as file_id, ord, ts, score, {BAND_SQL} as severity from frame_scores),
       {ml_sql('sc')} select {', '.join(ML_COLUMNS)} from ml""",
)
def stitch_ml(scores):
    """Spread over 200 files, so that gaps occur."""
    scored = scores.withColumn("file_id", F.col("file_id") * 1000 + F.col("ord") % 40).withColumn(
        "severity", classify_severity(F.col("score"), 35.0, 55.0, 75.0)
    )
    return fr.stitch_ml_events(scored).select(*ML_COLUMNS)


BURST_SQL = """bv as (select *, ymin < 16 and round(least(abs(ymin - 16) / 20.0e0, 1.0e0), 2) * 100.0e0 >= 80.0e0 as hu,
   ymax > 235 and round(least(abs(ymax - 235) / 20.0e0, 1.0e0), 2) * 100.0e0 >= 80.0e0 as ho,
   round(least(abs(ymin - 16) / 20.0e0, 1.0e0), 2) * 100.0e0 as cu, round(least(abs(ymax - 235) / 20.0e0, 1.0e0), 2) * 100.0e0 as co from frames),
 bw as (select file_id, frame_idx, pts_us, sum(cast(hu as int) + cast(ho as int)) over w as n,
   min(case when ymin < 16 or ymax > 235 or satmax > 110 then pts_us end) over w as first_us,
   arg_max(case when ho then ymax when hu then ymin end, case when ho or hu then frame_idx end) over w as worst,
   max(greatest(case when hu then cu else -1 end, case when ho then co else -1 end)) over w as conf
   from bv window w as (partition by file_id order by pts_us range between 1999999 preceding and current row)),
 bh as (select *, case when pts_us - lag(pts_us) over (partition by file_id order by pts_us, frame_idx) <= 500000 then 0 else 1 end as new from bw where n > 10),
 bi as (select *, sum(new) over (partition by file_id order by pts_us, frame_idx rows unbounded preceding) as isl from bh),
 bursts as (select file_id, arg_min(first_us, pts_us) / 1e6 as start_time, max(pts_us) / 1e6 as end_time, arg_min(worst, pts_us) as worst, arg_min(conf, pts_us) as confidence
   from bi group by file_id, isl)"""


@query(
    "broadcast_bursts", "frames",
    sql=f"""with {BURST_SQL} select file_id, 'broadcast_illegal_burst' as type, start_time, end_time, 'REJECTED' as severity,
       concat('sustained broadcast violation (>10 frames/2s). Worst: ', cast(worst as string)) as details, confidence from bursts""",
)
def bursts(frames):
    return broadcast_bursts(frames)


RUN_SQL = """vh as (select *, frame_idx - row_number() over (partition by file_id order by frame_idx) as isl from frames where vrep > 5.0e0),
 vruns as (select file_id, arg_min(pts_us, frame_idx) / 1e6 as "timestamp", 'VREP' as metric, max(vrep) as value, count(*) as duration_frames from vh group by file_id, isl having count(*) >= 3)"""


@query("vrep_runs", "frames", sql=f"with {RUN_SQL} select * from vruns")
def vrep(frames):
    return fr.vrep_runs(frames).drop("details")


def freeze_sql(dup: str) -> str:
    return f"""fl as (select file_id, max(frame_idx) as last from {dup} group by 1),
 fh as (select *, frame_idx - row_number() over (partition by file_id order by frame_idx) as isl from {dup} where is_dup),
 frozen as (select h.file_id, min(pts_us) / 1e6 as start_time, max(pts_us) / 1e6 as end_time from fh h join fl on fl.file_id = h.file_id
   group by h.file_id, isl, last having max(frame_idx) < last and max(pts_us) / 1e6 - min(pts_us) / 1e6 > 2.0e0 / 25.0e0)"""


@query("freeze_runs", "pixels", sql=f"with {DUP_SQL}, {freeze_sql('d')} select * from frozen")
def freezes(pixels):
    return fr.freeze_runs(marked(pixels), 25.0).select("file_id", "start_time", "end_time")


GAP_SQL = """gp as (select *, lag(pts_us) over (partition by file_id order by frame_idx) as prev from frames),
 gaps as (select file_id, frame_idx, prev / 1e6 as start_time, pts_us / 1e6 as end_time from gp where prev >= 0 and (pts_us - prev) / 1000.0e0 > 1000.0e0 / 25.0e0 * 1.5e0)"""


@query("frame_gaps", "frames", sql=f"with {GAP_SQL} select * from gaps")
def gaps(frames):
    return fr.frame_gaps(frames, 25.0).select("file_id", "frame_idx", "start_time", "end_time")


@query(
    "threshold_runs", "frames",
    sql="""with h as (select *, frame_idx - row_number() over (partition by file_id order by frame_idx) as isl from frames where satmax < 60)
       select file_id, min(frame_idx) as first_idx, max(frame_idx) as last_idx, min(pts_us) / 1e6 as start_time, max(pts_us) / 1e6 as end_time
       from h group by file_id, isl having max(pts_us) / 1e6 - min(pts_us) / 1e6 >= 0.1e0""",
)
def level_runs(frames):
    return fr.threshold_runs(frames, "satmax", 60, 0.1)


ERRORS_SQL = """x as (select file_id, line_no, trim(line, ' ' || chr(9) || chr(10) || chr(13)) as details,
   coalesce(try_cast(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2}\\.\\d+)', 1) as double) * 3600
     + try_cast(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2}\\.\\d+)', 2) as double) * 60
     + try_cast(regexp_extract(line, 'time=(\\d{2}):(\\d{2}):(\\d{2}\\.\\d+)', 3) as double), 0.0e0) as t,
   unnest(list_filter([case when regexp_matches(line, '(?i)DTS .* < .*') then 'non_monotonic_dts' end, case when regexp_matches(line, '(?i)PTS .* < .*') then 'non_monotonic_pts' end,
     case when regexp_matches(line, '(?i)Timestamp discontinuity') then 'timestamp_discontinuity' end,
     case when regexp_matches(line, '(?i)corrupt decoded frame') then 'corrupt_packet' end], lambda v: v is not null)) as type from logs),
 errs as (select file_id, line_no, type, details, t as start_time, t as end_time from x)"""

CAP_SQL = "capped as (select * from (select *, row_number() over (partition by file_id, type order by line_no) as rn from errs) q where rn <= 10)"


@query("classify_log_error", "logs", sql=f"with {ERRORS_SQL} select * from errs")
def errors(logs):
    return L.log_errors(logs)


@query(
    "cap_per_type", "logs",
    sql=f"with {ERRORS_SQL}, {CAP_SQL} select file_id, line_no, type, details, start_time, end_time from capped",
)
def capped(logs):
    return L.cap_per_type(L.log_errors(logs), 10)


@query(
    "motion_energy", "textured",
    sql="""with p as (select file_id, frame_idx, px, lag(px) over (partition by file_id order by frame_idx) as q from textured),
       d as (select file_id, frame_idx, cast(list_sum(list_transform(range(1, len(px) + 1), lambda i: abs(px[i] - q[i]))) as bigint) as e from p where q is not null)
       select file_id, frame_idx, case when max(e) over (partition by file_id) > 0 then e / max(e) over (partition by file_id) else e end as energy from d""",
)
def motion(pixels):
    return motion_energy(pixels)


@query(
    "max_normalise", "qc_base",
    sql="""with h as (select file_id, us // 3600000000 as i, cast(sum(case event_type when 'click' then cents else 0 end) as bigint) as a from qc_base group by 1, 2)
       select file_id, i, a / max(a) over (partition by file_id) as a from h""",
)
def scaled(base):
    return max_normalise(hourly(base).drop("v"), "a")

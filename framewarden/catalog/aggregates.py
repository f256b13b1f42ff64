"""Roll-ups and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import sound, video
from ..functions import logs as L
from ..operators import events as ev
from ..operators import frames as fr
from ..operators import grading, jobs, verdicts
from ..operators.intervals import severity_heatmap
from ..operators.segments import merge_segment_details
from . import query
from .joins import GRADE_SQL, cases

RANK = """case s when 'CRASHED' then 4 when 'REJECTED' then 3 when 'CORRUPT' then 3 when 'WARNING' then 2 when 'PASSED' then 1 else 0 end"""


@query(
    "overall_status", "mixed_reports",
    sql=f"""with r as (select file_id, ord, coalesce(effective_status, status, 'UNKNOWN') as s from mixed_reports)
       select file_id, case when max({RANK}) > 0 then arg_max(s, ({RANK}, -ord)) else 'PASSED' end as overall_status from r group by 1""",
)
def overall(reports):
    return verdicts.overall_status(reports)


_ANY = """case when coalesce(bool_or(status = 'REJECTED'), false) then 'REJECTED' when coalesce(bool_or(status = 'WARNING'), false) then 'WARNING' else 'PASSED' end"""


@query(
    "module_status_escalation", "mixed_reports",
    sql=f"""select file_id, module, {_ANY} as status from mixed_reports group by 1, 2
       union all select file_id, 'all', {_ANY} from mixed_reports group by 1""",
)
def escalation(reports):
    modules = verdicts.escalate(reports, ["file_id", "module"])
    files = verdicts.escalate(modules, ["file_id"]).withColumn("module", F.lit("all"))
    return modules.unionByName(files)


@query(
    "segment_worst_status", "mixed_reports",
    sql="""select file_id, case when max(case status when 'ERROR' then 4 when 'REJECTED' then 3 when 'WARNING' then 2 else 1 end) = 1 then 'PASSED'
       else arg_max(status, case status when 'ERROR' then 4 when 'REJECTED' then 3 when 'WARNING' then 2 else 1 end) end as overall_status
       from mixed_reports group by 1""",
)
def segment_worst(reports):
    return verdicts.segment_worst_status(reports)


@query(
    "segment_summary", "segment_reports",
    sql="""select file_id, count(distinct segment_id) as total_segments, count(*) filter (status = 'REJECTED') as total_errors,
       count(*) filter (status = 'WARNING') as total_warnings from segment_reports group by 1""",
)
def segment_summary(reports):
    return verdicts.segment_summary(reports)


@query(
    "signal_metrics", "frames",
    sql="""select file_id, min(ymin) as signal_min_y, max(ymax) as signal_max_y,
       count(*) filter (ymin < 16) + count(*) filter (ymax > 235) as broadcast_illegal_frames,
       count(*) filter (satmax > 110) as saturation_warnings, count(*) as total_frames from frames group by 1""",
)
def signal_metrics(frames):
    return video.signal_metrics(frames)


@query(
    "phase_metrics", "audio_frames",
    sql="""select file_id, round(avg(phase), 4) as mean_phase_correlation, round(min(phase), 4) as min_phase_correlation from audio_frames group by 1""",
)
def phase_metrics(frames):
    return sound.phase_metrics(frames).select("file_id", "mean_phase_correlation", "min_phase_correlation")


@query(
    "quality_metrics", "frame_scores",
    sql="""select file_id, count(*) as frames_analyzed, round(sum(cast(round(score * 100) as bigint)) / (count(*) * 100), 2) as avg_quality_score,
       round(max(score), 2) as worst_score from frame_scores where score >= 0 group by 1""",
)
def quality_metrics(scores):
    return video.quality_metrics(scores)


DUP_SQL = """d as (select file_id, frame_idx, frame_idx * 40000 as pts_us, coalesce(len(list_filter(list_zip(px, lag(px) over (partition by file_id order by frame_idx)), lambda z: z[1] <> z[2])) < 35
   and frame_idx > 0, false) as is_dup from pixels)"""


def marked(pixels):
    return fr.mark_duplicates(pixels.withColumn("pts_us", F.col("frame_idx") * 40000), 35)


@query(
    "duplicate_count", "pixels",
    sql=f"with {DUP_SQL} select file_id, count(*) filter (is_dup) as duplicate_frame_count from d group by 1",
)
def duplicate_count(pixels):
    return fr.duplicate_count(marked(pixels))


@query(
    "max_pts_drift", "frames",
    sql="""select file_id, coalesce(max(case when frame_idx > 0 then abs(pts_us / 1000.0e0 - frame_idx * 40.0e0) end), 0.0e0) as max_pts_drift_ms from frames group by 1""",
)
def max_pts_drift(frames):
    return fr.max_pts_drift(frames, 25.0)


VALUES_SQL = """vals as (select file_id, segment_id, module, max(v) + (segment_id * 7 + file_id) % 5 as v from segment_reports group by 1, 2, 3),
keyed as (select file_id, segment_id, module, unnest(['mean_phase_correlation', 'min_phase_correlation', 'sync_Offset', 'container']) as key, v from vals),
merged as (select file_id, module, key, case
   when contains(key, 'mean_phase') then list_reduce(list(v order by segment_id), lambda a, x: (a + x) / 2)
   when contains(key, 'min_phase') then min(v) when contains(lower(key), 'offset') then max(v) else arg_min(v, segment_id) end as v
  from keyed group by 1, 2, 3)"""


def segment_values(reports):
    """One value per segment, module and metric name."""
    value = F.max("v") + (F.col("segment_id") * 7 + F.col("file_id")) % 5
    keys = F.array(*[F.lit(k) for k in ("mean_phase_correlation", "min_phase_correlation", "sync_Offset", "container")])
    return reports.groupBy("file_id", "segment_id", "module").agg(value.alias("v")).withColumn("key", F.explode(keys))


@query("merge_segment_details", "segment_reports", sql=f"with {VALUES_SQL} select file_id, module, key, v from merged")
def merge_details(reports):
    return merge_segment_details(segment_values(reports))


CAL_SQL = """cal as (select file_id, count(*) as frames_processed, max(vrep) as vrep_max, round(avg(vrep), 6) as vrep_mean,
  count(*) filter (vrep > 5.0e0) as vrep_spike_count, min(ymin) as ymin_min, max(ymax) as ymax_max from frames group by 1)"""


@query("calibration_signal", "frames", sql=f"with {CAL_SQL} select * from cal")
def calibration_signal(frames):
    return grading.calibration_signal(frames).withColumn("vrep_mean", F.round("vrep_mean", 6))


def _sum(expr: str) -> str:
    return f"list_sum(list_transform(range(1, n + 1), lambda i: {expr}))"


FIELD_SQL = f"""fs as (select file_id, frame_idx // 2 as half, list_filter(px, lambda x, i: ((i - 1) // width) % 2 = 0) as e,
   list_filter(px, lambda x, i: ((i - 1) // width) % 2 = 1) as o, cast(len(px) / 2 as bigint) as n from {{0}} where frame_idx % 2 = 0),
 fq as (select *, {_sum('e[i]')} / n as m1, {_sum('o[i]')} / n as m2, {_sum('e[i] * e[i]')} / n as q1, {_sum('o[i] * o[i]')} / n as q2,
   {_sum('e[i] * o[i]')} / n as q12, {_sum('(e[i] - o[i]) * (e[i] - o[i])')} / n as mse,
   lag(o) over (partition by file_id order by half) as po from fs),
 fm as (select file_id, case when mse = 0 then 100.0e0 else 20.0e0 * log10(255.0e0 / sqrt(mse)) end as psnr,
   ((2 * m1 * m2 + 6.5025e0) * (2 * (q12 - m1 * m2) + 58.5225e0)) / ((m1 * m1 + m2 * m2 + 6.5025e0) * ((q1 - m1 * m1) + (q2 - m2 * m2) + 58.5225e0)) as ssim,
   case when po is not null then {_sum('abs(o[i] - po[i])')} / n end as dv from fq),
 fields as (select file_id, count(*) as frames, round(avg(psnr), 6) as avg_psnr, round(min(psnr), 6) as min_psnr, round(avg(ssim), 6) as avg_ssim,
   round(min(ssim), 6) as min_ssim, round(coalesce(avg(dv), 0.0e0), 6) as avg_temp_div from fm group by 1)"""

FIELD_COLUMNS = ("avg_psnr", "min_psnr", "avg_ssim", "min_ssim", "avg_temp_div")


def rounded_fields(df):
    return df.withColumns({c: F.round(c, 6) for c in FIELD_COLUMNS})


@query("field_metrics", "textured", sql=f"with {FIELD_SQL.format('textured')} select * from fields")
def field_metrics(pixels):
    return rounded_fields(fr.field_metrics(pixels))


TIER_SQL = """t as (select case when contains(lower(frame_name), 'high') then 'HIGH' when contains(lower(frame_name), 'medium') then 'MEDIUM'
   when contains(lower(frame_name), 'low') then 'LOW' else 'UNKNOWN' end as tier, score from named_scores),
 ts as (select tier, count(*) as n, min(score) as min_score, max(score) as max_score, avg(score) as mean, stddev_pop(score) as std from t where tier <> 'UNKNOWN' group by 1)"""


@query(
    "quality_tier_stats", "named_scores",
    sql=f"""with {TIER_SQL} select tier, n, min_score, max_score, round(mean, 4) as mean, round(std, 4) as std,
       case tier when 'HIGH' then case when mean < 45 then 'PASS' else 'HIGH' end
       when 'MEDIUM' then case when mean between 30 and 65 then 'PASS' else 'DEVIATION' end
       else case when mean > 55 then 'PASS' else 'LOW' end end as verdict from ts""",
)
def tier_stats(scores):
    return grading.quality_tier_stats(scores).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "recommend_threshold", "named_scores",
    sql=f"""with {TIER_SQL} select round(coalesce((max(case tier when 'MEDIUM' then mean end) + max(case tier when 'LOW' then mean end)) / 2, 55.0e0), 4) as recommended_threshold from ts""",
)
def recommend(scores):
    best = grading.recommend_threshold(grading.quality_tier_stats(scores))
    return best.select(F.round("recommended_threshold", 4).alias("recommended_threshold"))


@query(
    "executive_summary", "batch_results", "found_types",
    sql="""with t as (select name, list(distinct type order by type) as ty from found_types group by name)
       select filename, status, coalesce(array_to_string(ty, ', '), '') as defects, duration from batch_results left join t on name = file_id""",
)
def executive(results, found):
    return ev.executive_summary(results, found.withColumnRenamed("name", "file_id"))


CATEGORY_SQL = """case when contains(m, 'audio') or contains(m, 'loudness') or contains(t, 'silence') then '{0}'
  when contains(m, 'sync') or contains(t, 'drift') then '{1}' when contains(m, 'structure') or contains(t, 'metadata') then '{2}'
  when contains(t, 'broadcast') or contains(t, 'saturation') then '{3}' when contains(t, 'artifact') or contains(t, 'bitrate') or contains(d, 'block') then '{4}'
  when contains(t, 'black') or contains(t, 'freeze') or contains(t, 'interlace') then '{5}' else '{6}' end"""

TITLE_SQL = """array_to_string(list_transform(range(1, length(x) + 1), lambda i: case when i > 1 and regexp_matches(x[i - 1], '[a-z]') then x[i] else upper(x[i]) end), '')"""

SCORE_SQL = """case upper(coalesce(severity, 'UNKNOWN')) when 'CRITICAL' then 5 when 'REJECTED' then 5 when 'SEVERE' then 5 when 'MODERATE' then 3
  when 'WARNING' then 2 when 'PASSED' then 0 else 1 end"""


def smpte_sql(sec: str) -> str:
    f = f"cast(trunc({sec} * 24) as bigint)"
    return f"printf('%02d:%02d:%02d:%02d', {f} // 86400, ({f} // 1440) % 60, ({f} // 24) % 60, {f} % 24)"


DESCRIBED_SQL = f"""n as (select file_id, ord, type, module as origin_module, severity, details,
   coalesce(start_time, "timestamp", 0.0e0) as start_time, coalesce(end_time, coalesce(start_time, "timestamp", 0.0e0) + 1.0e0) as end_time,
   lower(module) as m, lower(type) as t, lower(coalesce(details, '')) as d, replace(lower(type), '_', ' ') as x from worded),
 described as (select *, {CATEGORY_SQL.format('Audio', 'Sync', 'Structure', 'Archival', 'Video Quality', 'Video Error', 'Other')} as category,
   {CATEGORY_SQL.format('AUD', 'SYN', 'STR', 'ARC', 'VQUAL', 'VERR', 'GEN')} as datavyu_code, {TITLE_SQL} as human_name,
   {SCORE_SQL} as severity_score, upper(coalesce(severity, 'UNKNOWN')) as original_severity from n)"""

ISSUE_SQL = f"""issues as (select file_id, human_name, count(*) as n, max(severity_score) as max_severity, arg_min(category, (start_time, ord)) as category,
   max(severity_score) >= 3 as is_fail,
   concat(array_to_string(list({smpte_sql('start_time')} order by start_time, ord)[1:3], ', '),
     case when count(*) > 3 then concat(' (+', count(*) - 3, ' more)') else '' end) as times from described group by 1, 2)"""


@query("issue_summary", "worded", sql=f"with {DESCRIBED_SQL}, {ISSUE_SQL} select * from issues")
def issues(worded):
    return ev.issue_summary(ev.describe_events(ev.normalize_event_time(worded)))


HEAT_SQL = """ext as (select file_id, cast(trunc(case when max(end_time) <= 0 then 10.0e0 else max(end_time) end) as bigint) as last from described group by 1),
 cover as (select d.file_id, unnest(range(greatest(0, least(cast(trunc(start_time) as bigint), last)), greatest(0, least(cast(trunc(end_time) as bigint), last)) + 1)) as bin,
   greatest(1, severity_score) as level from described d join ext on ext.file_id = d.file_id),
 heat as (select b.file_id, b.bin, coalesce(max(level), 0) as level from (select file_id, unnest(range(0, last + 1)) as bin from ext) b
   left join cover c on c.file_id = b.file_id and c.bin = b.bin group by 1, 2)"""


@query("severity_heatmap", "worded", sql=f"with {DESCRIBED_SQL}, {HEAT_SQL} select * from heat")
def heatmap(worded):
    return severity_heatmap(ev.describe_events(ev.normalize_event_time(worded)))


@query(
    "batch_tally", "batch_results",
    sql="select count(*) as total, count(*) filter (outcome = 'SUCCESS') as passed, count(*) filter (outcome <> 'SUCCESS') as failed from batch_results",
)
def tally(results):
    return ev.batch_tally(results)


@query(
    "job_stats", "jobs",
    sql="""select count(*) as total, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'FAILED') as failed,
       round(count(*) filter (status = 'COMPLETED') / count(*) * 100, 1) as pass_rate from jobs""",
)
def stats(df):
    return jobs.job_stats(df)


@query(
    "system_accuracy", "test_plan", "found_types",
    sql=f"with {GRADE_SQL} select count(*) as cases, count(*) filter (grade = 'PASS') * 100 / count(*) as accuracy_pct from g",
)
def accuracy(plan, found):
    planned, results = cases(plan, found)
    return grading.system_accuracy(grading.grade_cases(planned, results, found))


ASTATS_SQL = """a as (select *, case when contains(line, 'Overall.DC_offset') then try_cast(split_part(line, '=', 2) as double) end as dc,
   case when contains(line, 'Overall.Dynamic_range') then try_cast(split_part(line, '=', 2) as double) end as dr,
   try_cast(regexp_extract(line, 'max_volume:\\s*([-0-9.]+)\\s*dB', 1) as double) as mv from logs)"""


@query(
    "audio_metrics", "logs",
    sql=f"""with {ASTATS_SQL} select file_id, max(abs(dc)) as dc_offset_max, arg_max(dr, line_no) filter (dr is not null) as dynamic_range_db,
       arg_min(mv, line_no) filter (mv is not null) as peak_volume_db from a group by 1""",
)
def audio_metrics(logs):
    return sound.audio_metrics(logs)


@query(
    "true_peak_max", "logs",
    sql="""select file_id, arg_max(list_max(list_filter(list_transform(string_split_regex(trim(regexp_extract(trim(line), '^True peak:(.*?)dBTP', 1)), '\\s+'),
         lambda w: try_cast(w as double)), lambda v: v is not null)), line_no) as true_peak from logs where regexp_matches(trim(line), '^True peak:.*dBTP') group by 1""",
)
def true_peak(logs):
    return L.parse_loudness_summary(logs).select("file_id", "true_peak")


@query(
    "vrep_spike_count", "frames",
    sql="""with h as (select *, frame_idx - row_number() over (partition by file_id order by frame_idx) as isl from frames where vrep > 5.0e0),
       r as (select file_id, isl from h group by 1, 2 having count(*) >= 3)
       select f.file_id, (select count(*) from r where r.file_id = f.file_id) as vrep_spikes from (select distinct file_id from frames) f""",
)
def spikes(frames):
    return fr.vrep_spike_count(frames)


CROP_SQL = """crop as (select file_id, cast(c[1] as int) as w, cast(c[2] as int) as h, cast(c[3] as int) as x, cast(c[4] as int) as y from
  (select file_id, string_split(substr(arg_max(list_extract(regexp_extract_all(line, 'crop=\\d+:\\d+:\\d+:\\d+'), -1), line_no), 6), ':') as c
   from logs where regexp_matches(line, 'crop=\\d+:\\d+:\\d+:\\d+') group by 1) t)"""


@query("active_area_last", "logs", sql=f"with {CROP_SQL} select * from crop")
def area_last(logs):
    return L.last_crop(logs)

"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import logs as L
from ..functions import timecode as T
from ..functions import wording as W
from ..functions.canonical import settings_hash
from ..functions.quality import field, field_sums, psnr
from ..operators.events import datavyu_rows, describe_events, normalize_event_time
from ..operators.grading import tier_from_name
from ..operators.segments import shift_times, tag_origin
from ..profiles import PROFILES, config_hash, governance, join_profile, profiles_table, settings_rows
from . import query
from .aggregates import CATEGORY_SQL, DESCRIBED_SQL, FIELD_SQL, TITLE_SQL, smpte_sql
from .scans import registered


@query("seconds_to_smpte", "worded", sql=f"select file_id, ord, {smpte_sql('coalesce(start_time, 0.0e0)')} as smpte from worded")
def to_smpte(worded):
    return worded.select("file_id", "ord", T.seconds_to_smpte(F.col("start_time")).alias("smpte"))


@query(
    "smpte_to_seconds", "worded",
    sql="""with f as (select file_id, ord, k, cast(trunc(coalesce(start_time, 0.0e0) * 24) as bigint) as f from (select *, ord % 40 as k from worded) w)
       select file_id, ord, case when k = 0 or k = 1 then 0.0e0 else (f // 24) + (f % 24) / 24.0e0 end as seconds from f""",
)
def from_smpte(worded):
    k = F.col("ord") % 40
    code = T.seconds_to_smpte(F.col("start_time"))
    text = F.when(k == 0, F.lit("")).when(k == 1, F.substring(code, 1, 8)).otherwise(code)
    return worded.select("file_id", "ord", T.smpte_to_seconds(text).alias("seconds"))


@query(
    "clock_to_seconds", "logs",
    sql="""select file_id, line_no, case when regexp_matches(line, 'time=\\d{2}:\\d{2}:\\d{2}\\.\\d+')
       then cast(regexp_extract(line, 'time=(\\d{2})', 1) as int) * 3600 + cast(regexp_extract(line, 'time=\\d{2}:(\\d{2})', 1) as int) * 60
         + cast(regexp_extract(line, 'time=\\d{2}:\\d{2}:(\\d{2}\\.\\d+)', 1) as double) else 0.0e0 end as seconds from logs""",
)
def clock(logs):
    return logs.select("file_id", "line_no", T.clock_to_seconds(F.col("line")).alias("seconds"))


@query(
    "normalize_event_time", "worded",
    sql="""select file_id, ord, coalesce(start_time, "timestamp", 0.0e0) as start_time,
       coalesce(end_time, coalesce(start_time, "timestamp", 0.0e0) + 1.0e0) as end_time, module as origin_module from worded""",
)
def event_time(worded):
    return normalize_event_time(worded).select("file_id", "ord", "start_time", "end_time", "origin_module")


@query("categorize_event", "worded", sql=f"with {DESCRIBED_SQL} select file_id, ord, category, datavyu_code from described")
def categorize(worded):
    return describe_events(normalize_event_time(worded)).select("file_id", "ord", "category", "datavyu_code")


@query(
    "severity_score", "worded",
    sql=f"""with {DESCRIBED_SQL} select file_id, ord, severity_score, case category when 'Audio' then '#1f77b4' when 'Video Error' then '#d62728'
       when 'Video Quality' then '#ff7f0e' when 'Archival' then '#00bcd4' when 'Sync' then '#2ca02c' when 'Structure' then '#9467bd' else '#7f7f7f' end as color from described""",
)
def score(worded):
    return describe_events(normalize_event_time(worded)).select("file_id", "ord", "severity_score", "color")


@query("human_name", "worded", sql=f"with {DESCRIBED_SQL} select file_id, ord, human_name from described")
def names(worded):
    return worded.select("file_id", "ord", W.human_name(F.col("type")).alias("human_name"))


DATAVYU_SQL = """vyu as (select file_id, cast(trunc(start_time * 1000) as bigint) as onset, cast(trunc(end_time * 1000) as bigint) as "offset", datavyu_code as code01,
  original_severity as code02, concat(human_name, ': ', coalesce(details, '')) as comment from described)"""


@query("datavyu_rows", "worded", sql=f"with {DESCRIBED_SQL}, {DATAVYU_SQL} select * from vyu")
def vyu(worded):
    return datavyu_rows(describe_events(normalize_event_time(worded)))


@query(
    "parse_ratio", "probes_flat",
    sql="""with r as (select file_id, unnest([sar, dar]) as ratio from probes_flat)
       select file_id, ratio, case ratio when '8:9' then 8 / 9.0e0 when '10:11' then 10 / 11.0e0 when '4:3' then 4 / 3.0e0 when '16:9' then 16 / 9.0e0
         when '1:1' then 1.0e0 when '1.7778' then 1.7778e0 else 0.0e0 end as value from r""",
)
def ratio(flat):
    both = flat.select("file_id", F.explode(F.array("sar", "dar")).alias("ratio"))
    return both.select("file_id", "ratio", T.parse_ratio(F.col("ratio")).alias("value"))


SILENCE_SQL = """sil as (select file_id, line_no, round(e - d, 2) as start, round(e, 2) as "end" from (select file_id, line_no,
   try_cast(regexp_extract(line, 'silence_end: (\\S+) ', 1) as double) as e, try_cast(regexp_extract(line, 'silence_duration: (\\S+)', 1) as double) as d
   from {0} where contains(line, 'silence_end')) q where e - d is not null)"""


@query("parse_silence", "logs", sql=f"with {SILENCE_SQL.format('logs')} select * from sil")
def silence(logs):
    return L.parse_silence(logs).select("file_id", "line_no", "start", "end")


BLACK_SQL = """blk as (select file_id, line_no, cast(regexp_extract(line, 'black_start:([0-9.]+)', 1) as double) as start_time,
  cast(regexp_extract(line, 'black_end:([0-9.]+)', 1) as double) as end_time, cast(regexp_extract(line, 'black_duration:([0-9.]+)', 1) as double) as duration
  from logs where contains(line, 'black_start'))"""


@query("parse_black", "logs", sql=f"with {BLACK_SQL} select * from blk")
def black(logs):
    return L.parse_black(logs).select("file_id", "line_no", "start_time", "end_time", "duration")


@query(
    "parse_freeze", "logs",
    sql="""select file_id, line_no, case when contains(line, 'freeze_start') then 'start' else 'end' end as kind,
       cast(split_part(line, ': ', 2) as double) as "at" from logs where contains(line, 'lavfi.freezedetect.freeze_')""",
)
def freeze(logs):
    return L.parse_freeze(logs).select("file_id", "line_no", "kind", "at")


@query(
    "parse_loudness_summary", "logs",
    sql="""with l as (select file_id, line_no, trim(line) as t from logs)
       select file_id, arg_max(try_cast(trim(regexp_extract(t, '^I:(.*?)LUFS', 1)) as double), line_no) filter (regexp_matches(t, '^I:.*LUFS')) as integrated_lufs,
       arg_max(try_cast(trim(regexp_extract(t, '^LRA:(.*?)LU', 1)) as double), line_no) filter (regexp_matches(t, '^LRA:.*LU')) as lra from l group by 1""",
)
def loudness_summary(logs):
    return L.parse_loudness_summary(logs).select("file_id", "integrated_lufs", "lra")


@query(
    "parse_astats", "logs",
    sql="""select * from (select file_id, line_no, case when contains(line, 'Overall.DC_offset') then try_cast(split_part(line, '=', 2) as double) end as dc_offset,
       case when contains(line, 'Overall.Dynamic_range') then try_cast(split_part(line, '=', 2) as double) end as dynamic_range,
       try_cast(regexp_extract(line, 'max_volume:\\s*([-0-9.]+)\\s*dB', 1) as double) as max_volume from logs) q
       where coalesce(dc_offset, dynamic_range, max_volume) is not null""",
)
def astats(logs):
    return L.parse_astats(logs).select("file_id", "line_no", "dc_offset", "dynamic_range", "max_volume")


@query(
    "parse_loudnorm_json", "loudnorm_logs",
    sql="""with t as (select file_id, log, length(log) - strpos(reverse(log), '{') + 1 as a, length(log) - strpos(reverse(log), '}') + 1 as b,
         contains(log, '{') and contains(log, '}') as ok from loudnorm_logs),
       j as (select file_id, case when ok and a < b then substr(log, a, b - a + 1) end as j from t)
       select file_id, try_cast(json_extract_string(j, '$.input_i') as double) as input_i, try_cast(json_extract_string(j, '$.input_tp') as double) as input_tp,
         try_cast(json_extract_string(j, '$.input_lra') as double) as input_lra, try_cast(json_extract_string(j, '$.input_thresh') as double) as input_thresh
       from j where j is not null""",
)
def loudnorm(docs):
    return L.parse_loudnorm(docs)


@query(
    "parse_progress", "logs",
    sql="""with p as (select job_id, line_no, try_cast(regexp_extract(line, '\\[PROGRESS\\]\\s+(\\d+)', 1) as int) as pct,
         nullif(regexp_extract(line, '\\[PROGRESS\\]\\s+\\d+\\s+-\\s+(.*)', 1), '') as step from logs)
       select job_id, arg_max(pct, line_no) as progress, arg_max(step, line_no) filter (step is not null) as current_step from p where pct is not null group by 1""",
)
def progress(logs):
    return L.parse_progress(logs)


_HASH = "case resolved when 'strict' then '2a39001b' when 'netflix_hd' then '785f84ea' when 'youtube' then '6bbd4585' when 'ott' then '3e7a05c8' end"
_WORDS = "case resolved " + " ".join(f"when '{p}' then '{PROFILES[p]['description']}'" for p in PROFILES) + " end"
_RESOLVED = "(select *, case when profile = 'archive' then 'strict' else profile end as resolved from mixed_reports) m"


@registered("config_hash", "mixed_reports", sql=f"select distinct profile, {_HASH} as config_version_hash from {_RESOLVED}")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "mixed_reports").select("profile").distinct()
    return governance(asked, profiles_table(spark)).select("profile", "config_version_hash")


@registered("settings_hash", "mixed_reports", sql=f"select file_id, ord, {_HASH} as config_version_hash from {_RESOLVED}")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each report's settings, computed from the nested rows themselves."""
    rows = settings_rows(spark)
    known = rows.select("profile", settings_hash(F.col("settings"), rows.schema["settings"].dataType).alias("config_version_hash"))
    reports = load(spark, sf_dir, "mixed_reports").select("file_id", "ord", "profile")
    return join_profile(reports, known).select("file_id", "ord", "config_version_hash")


@registered(
    "governance_columns", "mixed_reports",
    sql=f"select file_id, ord, profile as active_profile, {_HASH} as config_version_hash, {_WORDS} as compliance_standard from {_RESOLVED}",
)
def govern(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = load(spark, sf_dir, "mixed_reports").select("file_id", "ord", "profile")
    return governance(reports, profiles_table(spark)).drop("profile")


SHIFT_SQL = "round(start_time + segment_start, 3) as start_time, round(end_time + segment_start, 3) as end_time"


@query("shift_times", "segment_events", sql=f"select file_id, ord, {SHIFT_SQL} from segment_events")
def shift(events):
    return shift_times(events).select("file_id", "ord", "start_time", "end_time")


@query(
    "tag_origin", "segment_events",
    sql="select file_id, ord, printf('[segment_%04d.mp4] %s', segment_id, details) as details from segment_events",
)
def tagged(events):
    return tag_origin(events, F.format_string("segment_%04d.mp4", "segment_id")).select("file_id", "ord", "details")


@query(
    "viz_duration", "worded",
    sql=f"""with {DESCRIBED_SQL} select file_id, ord, case when end_time - start_time <= 0 then 0.5e0 else end_time - start_time end as viz_duration from described""",
)
def viz(worded):
    e = normalize_event_time(worded)
    return e.select("file_id", "ord", W.display_duration(F.col("start_time"), F.col("end_time")).alias("viz_duration"))


@query(
    "tier_from_name", "named_scores",
    sql="""select frame_name, score, case when contains(lower(frame_name), 'high') then 'HIGH' when contains(lower(frame_name), 'medium') then 'MEDIUM'
       when contains(lower(frame_name), 'low') then 'LOW' else 'UNKNOWN' end as tier from named_scores""",
)
def tier(scores):
    return scores.select("frame_name", "score", tier_from_name(F.col("frame_name")).alias("tier"))


@query(
    "psnr", "textured",
    sql="""with q as (select file_id, frame_idx, list_sum(list_transform(range(1, 5), lambda r: list_sum(list_transform(range(1, 9), lambda c:
         (px[(r - 1) * 16 + c] - px[(r - 1) * 16 + 8 + c]) * (px[(r - 1) * 16 + c] - px[(r - 1) * 16 + 8 + c]))))) / 32 as mse from textured)
       select file_id, frame_idx, round(case when mse = 0 then 100.0e0 else 20.0e0 * log10(255.0e0 / sqrt(mse)) end, 6) as psnr from q""",
)
def field_psnr(pixels):
    s = field_sums(field(F.col("px"), F.col("width"), 0), field(F.col("px"), F.col("width"), 1))
    return pixels.withColumn("s", s).select("file_id", "frame_idx", F.round(psnr(F.col("s.dd") / F.col("s.n")), 6).alias("psnr"))

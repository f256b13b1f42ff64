"""The user-visible results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import load
from ..plans import checks as C
from ..plans import dashboard as D
from ..plans.master import master_report, merged_segments_flat, report_events, segmented_master
from ..profiles import profiles_table
from . import CHECKS, query
from .aggregates import (
    CAL_SQL, CROP_SQL, DESCRIBED_SQL, DUP_SQL, FIELD_COLUMNS, FIELD_SQL, HEAT_SQL, ISSUE_SQL, VALUES_SQL, rounded_fields, segment_values,
)
from .joins import GRADE_SQL, SERIES_SQL, STEP_SQL, _best_sql, cases, hourly
from .ordering import COLLECTED_SQL, documents
from .scalars import SHIFT_SQL, SILENCE_SQL
from .rules import _CROP, _LOUD, PROFILE_SQL
from .scans import nest_probes, registered
from .windows import (
    BURST_SQL, ERRORS_SQL, GAP_SQL, ML_COLUMNS, RUN_SQL, STITCHED_COLUMNS, STITCHED_SQL, freeze_sql, ml_sql, stitched_sql,
)

MASTER_SQL = f"""v as (select file_id, count(distinct module) as n_modules,
   max(case status when 'REJECTED' then 3 when 'WARNING' then 2 else 1 end) as r from reports group by 1),
 c as (select file_id, count(*) as n_events, min(start_time) as first_event, max(end_time) as last_event from stitched group by 1)"""


def flagship(spark: SparkSession, sf_dir: str):
    reports = load(spark, sf_dir, "reports").withColumn("effective_status", F.lit(None).cast("string"))
    return master_report(reports, load(spark, sf_dir, "timeline"), profiles_table(spark), profile="netflix_hd")


@registered(
    "master_report", "timeline", "reports",
    sql=f"""with {STITCHED_SQL}, {MASTER_SQL} select v.file_id, case r when 3 then 'REJECTED' when 2 then 'WARNING' else 'PASSED' end as overall_status,
       n_modules, coalesce(n_events, 0) as n_events, first_event, last_event, 'netflix_hd' as active_profile,
       '785f84ea' as config_version_hash, 'Netflix Delivery Spec v9.1 (HD/UHD)' as compliance_standard
       from v left join c on c.file_id = v.file_id""",
)
def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).files.drop("profile")


@registered(
    "master_modules", "reports",
    sql="""select file_id, module, arg_max(status, (ord, report_id)) as status from reports group by 1, 2""",
)
def master_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.master import module_table

    reports = load(spark, sf_dir, "reports").withColumn("effective_status", F.lit(None).cast("string"))
    return module_table(reports.withColumn("ord", F.struct("ord", "report_id")))


@query(
    "master_timeline", "docs_flat",
    sql=f"""with {COLLECTED_SQL}, tl as (select file_id, report_ord * 1048576 + pos as ord, type, coalesce(start_time, 0.0e0) as start_time, end_time,
         source_module as severity, source_module as details from ev), {stitched_sql('tl')}
       select file_id, type, start_time, end_time, severity as source_module, n_events from stitched""",
)
def master_timeline(flat):
    """Stitched timeline of nested report documents."""
    from ..operators.intervals import stitch_events

    events = report_events(documents(flat))
    return stitch_events(events, carry=("source_module",)).select(
        "file_id", "type", "start_time", "end_time", "source_module", "n_events"
    )


SEGMENT_REPORTS_SQL = """sr as (select file_id, segment_id, module, status from segment_events)"""


def segmented(events: DataFrame, values: DataFrame):
    segments = events.select("file_id", "segment_id", F.col("segment_start").alias("start_time")).distinct()
    return segmented_master(
        events.select("file_id", "segment_id", "module", "status"), events.drop("segment_start"), values, segments
    )


@query(
    "segmented_master", "segment_events", "segment_reports",
    sql=f"""with sh as (select file_id, type, ord, severity, details, {SHIFT_SQL} from segment_events), {stitched_sql('sh')}
       select file_id, case when bool_or(status = 'REJECTED') then 'REJECTED' when bool_or(status = 'WARNING') then 'WARNING' else 'PASSED' end as status,
         count(distinct segment_id) as total_segments, count(*) filter (status = 'REJECTED') as total_errors, count(*) filter (status = 'WARNING') as total_warnings,
         (select count(*) from stitched s where s.file_id = e.file_id) as n_events from segment_events e group by 1""",
)
def segmented_files(events, reports):
    parts = segmented(events, segment_values(reports))
    counts = parts["events"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n_events"))
    return parts["files"].join(counts, "file_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query(
    "segmented_timeline", "segment_events", "segment_reports",
    sql=f"""with sh as (select file_id, type, ord, severity, details, {SHIFT_SQL} from segment_events), {stitched_sql('sh')}
       select {', '.join(STITCHED_COLUMNS)} from stitched""",
)
def segmented_timeline(events, reports):
    return segmented(events, segment_values(reports))["events"].select(*STITCHED_COLUMNS)


@query(
    "segmented_details", "segment_events", "segment_reports",
    sql=f"with {VALUES_SQL} select file_id, module, key, v from merged",
)
def segmented_details(events, reports):
    return segmented(events, segment_values(reports))["details"]


def flat(events: DataFrame):
    segments = events.select("file_id", "segment_id", F.col("segment_start").alias("start_time")).distinct()
    from ..operators.verdicts import escalate

    masters = escalate(events, ["file_id", "segment_id"])
    return merged_segments_flat(masters, events.drop("segment_start"), segments)


@query(
    "merged_segments_flat", "segment_events",
    sql=f"""select file_id, ord, type, module, {SHIFT_SQL}, printf('[segment_%04d.mp4] %s', segment_id, details) as details from segment_events""",
)
def merged_flat(events):
    return flat(events)["events"].select("file_id", "ord", "type", "module", "start_time", "end_time", "details")


@query(
    "merged_segments_status", "segment_events",
    sql="""select file_id, case when bool_or(status = 'REJECTED') then 'REJECTED' when bool_or(status = 'WARNING') then 'WARNING' else 'PASSED' end as overall_status from segment_events group by 1""",
)
def merged_status(events):
    return flat(events)["files"]


@query(
    "frames_report", "logs", "pixels", "frames",
    sql=f"""with {ERRORS_SQL}, {GAP_SQL}, {DUP_SQL},
       dj as (select d.file_id, d.frame_idx, f.pts_us, d.is_dup from d join frames f on f.file_id = d.file_id and f.frame_idx = d.frame_idx),
       {freeze_sql('dj')},
       dr as (select file_id, coalesce(max(case when frame_idx > 0 then abs(pts_us / 1000.0e0 - frame_idx * 40.0e0) end), 0.0e0) as drift from frames group by 1),
       every as (select file_id from frames union select file_id from pixels union select file_id from logs),
       ev as (select file_id, type from errs union all select file_id, 'frame_gap' from gaps union all select file_id, 'freeze_frame' from frozen
         union all select file_id, 'timestamp_drift' from dr where drift > 100),
       n as (select file_id, count(*) as n_events, bool_or(type in ('non_monotonic_pts', 'corrupt_packet')) as bad, bool_or(type = 'frame_gap') as gap from ev group by 1),
       du as (select file_id, count(*) filter (is_dup) as dups from d group by 1)
       select every.file_id, coalesce(dups, 0) as duplicate_frame_count, round(coalesce(drift, 0.0e0), 2) as max_pts_drift_ms, coalesce(n_events, 0) as n_events,
         case when bad then 'REJECTED' when coalesce(dups, 0) > 24 or gap then 'WARNING' else 'PASSED' end as status
       from every left join dr on dr.file_id = every.file_id left join n on n.file_id = every.file_id left join du on du.file_id = every.file_id""",
)
def frames_report(logs, pixels, frames):
    files, events = C.frames_report({"logs": logs, "pixels": pixels, "frames": frames}, 25.0, 35)
    counts = events.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_events"))
    return files.join(counts, "file_id", "left").select(
        "file_id", "duplicate_frame_count", "max_pts_drift_ms", F.coalesce("n_events", F.lit(0)).alias("n_events"), "status"
    )


@query(
    "black_freeze_report", "logs",
    sql="""with l as (select file_id, line_no, line from logs),
       b as (select file_id, cast(regexp_extract(line, 'black_start:([0-9.]+)', 1) as double) as s, cast(regexp_extract(line, 'black_end:([0-9.]+)', 1) as double) as e
         from l where contains(line, 'black_start')),
       bt as (select file_id, case when s < 1 then 'fade_in' when e > 699 then 'fade_out' else 'black_frame_error' end as type, s as start_time, e as end_time from b),
       freeze_tokens as (select file_id, line_no, case when contains(line, 'freeze_start') then 'start' else 'end' end as kind, cast(split_part(line, ': ', 2) as double) as "at"
         from l where contains(line, 'lavfi.freezedetect.freeze_')),"""
    + """ s as (select *, sum(case kind when 'start' then 1 else -1 end) over (partition by file_id order by line_no rows unbounded preceding) as s from freeze_tokens),
m as (select *, least(0, coalesce(min(s) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding), 0)) as m from s),
lv as (select *, s - m + case kind when 'start' then 0 else 1 end as level from m where kind = 'start' or s >= m),
p as (select *, lag("at") over (partition by file_id, level order by line_no) as start_time from lv)
select file_id, 'video_freeze' as type, start_time, "at" as end_time from p where kind = 'end' union all select file_id, type, start_time, end_time from bt""",
)
def black_freeze(logs):
    durations = logs.select("file_id").distinct().withColumn("duration_sec", F.lit(700.0))
    return C.check_black_freeze({"logs": logs, "durations": durations}).events.select("file_id", "type", "start_time", "end_time")


def _channels(logs: DataFrame) -> DataFrame:
    return logs.select("file_id").distinct().withColumn("channels", F.least(F.col("file_id"), F.lit(2)).cast("int"))


@query(
    "audio_signal_report", "logs",
    sql=f"""with {SILENCE_SQL.format('logs')},
       src as (select * from sil where file_id > 0), mono as (select file_id + 1 as file_id, start, "end" from sil where file_id + 1 between 2 and 4),
       canc as (select * from mono m where not exists (select 1 from sil s where s.file_id = m.file_id and m.start < s."end" and m."end" > s.start)),
       met as (select file_id, max(abs(case when contains(line, 'Overall.DC_offset') then try_cast(split_part(line, '=', 2) as double) end)) as dc from logs where file_id > 0 group by 1),
       f as (select distinct file_id from logs),
       t as (select f.file_id, coalesce(dc, 0.0e0) as dc_offset_max, (select count(*) from src s where s.file_id = f.file_id) as n_dropouts,
         (select count(*) from canc c where c.file_id = f.file_id) as n_cancelled,
         (select count(*) from src s where s.file_id = f.file_id and s."end" - s.start > 2.0e0) as n_long from f left join met on met.file_id = f.file_id)
       select file_id, dc_offset_max, n_dropouts, n_cancelled,
         case when n_cancelled > 0 or n_long > 0 then 'REJECTED' when n_dropouts > 0 or dc_offset_max > 0.001e0 then 'WARNING' else 'PASSED' end as status from t""",
)
def audio_report(logs):
    """The channel sum's log is stood in for by the neighbouring file's log."""
    mono = logs.withColumn("file_id", F.col("file_id") + 1)
    files, events = C.audio_signal_report({"logs": logs, "mono_logs": mono, "channels": _channels(logs)})
    kinds = events.groupBy("file_id").agg(
        F.count_if(F.col("type") == "audio_dropout").alias("n_dropouts"),
        F.count_if(F.col("type") == "phase_inversion_detected").alias("n_cancelled"),
    )
    zero = F.lit(0)
    return files.join(kinds, "file_id", "left").select(
        "file_id", "dc_offset_max", F.coalesce("n_dropouts", zero).alias("n_dropouts"),
        F.coalesce("n_cancelled", zero).alias("n_cancelled"), "status",
    )


@registered(
    "artifacts_report", "bitrates", "qc_base",
    sql=f"""with raw as (select user_id as file_id, event_id as ord, (us // 3600000) / 1000.0e0 as ts, (cents % 10000) / 100.0e0 as score from qc_base),
       sc as (select *, case when score >= 70 then 'SEVERE' when score >= 55 then 'MODERATE' when score >= 40 then 'MILD' else 'CLEAN' end as severity from raw),
       {ml_sql('sc')},
       ev as (select file_id, severity from ml union all select file_id, 'CRITICAL' from bitrates where width > 0 and height > 0 and bit_rate / (width * height) < 0.02e0),
       n as (select file_id, count(*) as n_events, bool_or(severity in ('CRITICAL', 'SEVERE')) as bad, bool_or(severity in ('WARNING', 'MODERATE')) as warn from ev group by 1),
       q as (select file_id, count(*) as frames_analyzed, round(max(score), 2) as worst_score from sc group by 1)
       select b.file_id, frames_analyzed, worst_score, coalesce(n_events, 0) as n_events, case when bad then 'REJECTED' when warn then 'WARNING' else 'PASSED' end as status
       from bitrates b left join n on n.file_id = b.file_id left join q on q.file_id = b.file_id""",
)
def artifacts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = load(spark, sf_dir, "qc_base").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("ord"), (F.floor(F.col("us") / 3600000) / 1000.0).alias("ts"),
        (F.col("cents") % 10000 / 100.0).alias("score"),
    )
    files, events = C.artifacts_report({"bitrates": load(spark, sf_dir, "bitrates"), "scores": scores}, profiles_table(spark), "ott")
    counts = events.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_events"))
    return files.join(counts, "file_id", "left").select(
        "file_id", "frames_analyzed", "worst_score", F.coalesce("n_events", F.lit(0)).alias("n_events"), "status"
    )


@query(
    "dashboard_timeline", "worded",
    sql=f"""with {DESCRIBED_SQL} select file_id, ord, category, human_name, start_time,
       case when end_time - start_time <= 0 then 0.5e0 else end_time - start_time end as viz_duration, severity_score from described""",
)
def dashboard(worded):
    bars = D.dashboard_tables(worded)["timeline"]
    return bars.select("file_id", "ord", "category", "human_name", "start_time", "viz_duration", "severity_score")


@query(
    "dashboard_tables", "worded",
    sql=f"""with {DESCRIBED_SQL}, {ISSUE_SQL}, {HEAT_SQL},
       b as (select file_id, count(*) as n_bars from described group by 1),
       i as (select file_id, count(*) as n_issues, count(*) filter (is_fail) as n_fail from issues group by 1),
       h as (select file_id, count(*) as seconds, count(*) filter (level = 5) as critical_seconds, count(*) filter (level = 0) as clean_seconds from heat group by 1)
       select b.*, n_issues, n_fail, seconds, critical_seconds, clean_seconds from b join i on i.file_id = b.file_id join h on h.file_id = b.file_id""",
)
def dashboard_tables(worded):
    """Size of each file's three dashboard tables."""
    tables = D.dashboard_tables(worded)
    n = F.count(F.lit(1))
    bars = tables["timeline"].groupBy("file_id").agg(n.alias("n_bars"))
    issues = tables["issues"].groupBy("file_id").agg(n.alias("n_issues"), F.count_if("is_fail").alias("n_fail"))
    heat = tables["heatmap"].groupBy("file_id").agg(
        n.alias("seconds"), F.count_if(F.col("level") == 5).alias("critical_seconds"),
        F.count_if(F.col("level") == 0).alias("clean_seconds"),
    )
    return bars.join(issues, "file_id").join(heat, "file_id")


@query(
    "calibration_report", "frames", "textured", "logs",
    sql=f"""with {CAL_SQL}, {FIELD_SQL.format('textured')}, {CROP_SQL}
       select * from cal full join (select file_id, {', '.join(FIELD_COLUMNS)} from fields) f using (file_id) full join crop using (file_id)""",
)
def calibration(frames, pixels, logs):
    report = D.calibration_report(frames, pixels, logs)
    return rounded_fields(report).withColumn("vrep_mean", F.round("vrep_mean", 6))


@query(
    "benchmark_grade", "test_plan", "found_types",
    sql=f"with {GRADE_SQL} select status, grade, count(*) as n from g group by 1, 2",
)
def benchmark(plan, found):
    planned, results = cases(plan, found)
    graded, _ = D.benchmark_grade(planned, results, found)
    return graded.groupBy("status", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(
    "avsync_report", "qc_base",
    sql=f"""with {SERIES_SQL}, e as (select file_id, max(i) as last from h group by 1),
       h0 as (select * from h where i >= 0 and i < 240),
       t0 as (select h.* from h join e on e.file_id = h.file_id where last + 1 > 480 and h.i > last - 240),
       head as (select file_id, i, a / max(a) over (partition by file_id) as a, v / max(v) over (partition by file_id) as v from h0),
       tail as (select file_id, i, a / max(a) over (partition by file_id) as a, v / max(v) over (partition by file_id) as v from t0),
       {_best_sql('head', 'bh')}, {_best_sql('tail', 'bt')},
       o as (select bh.file_id, bh.corr, bh.lag * ({STEP_SQL}) as oh, coalesce(bt.lag, bh.lag) * ({STEP_SQL}) as ot from bh left join bt on bt.file_id = bh.file_id)
       select file_id, round(oh, 2) as offset_head_ms, round(ot, 2) as offset_tail_ms, round(greatest(abs(oh), abs(ot)), 2) as max_offset_ms,
         round(corr, 2) as confidence_score,
         case when greatest(abs(oh), abs(ot)) > 40 then 'REJECTED' when abs(ot - oh) > 15 then 'WARNING' else 'PASSED' end as status from o""",
)
def avsync(base):
    durations = base.select("file_id").distinct().withColumn("duration_sec", F.lit(720.0))
    files, _ = C.avsync_report(hourly(base), durations, window=240)
    return files.select("file_id", "offset_head_ms", "offset_tail_ms", "max_offset_ms", "confidence_score", "status")


@query(
    "ml_timeline", "frame_scores",
    sql=f"""with sc as (select file_id, ord, ts, round(score, 2) as score, case when score >= 75 then 'SEVERE' when score >= 55 then 'MODERATE' when score >= 35 then 'MILD' else 'CLEAN' end as severity from frame_scores),
       {ml_sql('sc')} select {', '.join(ML_COLUMNS)} from ml""",
)
def ml_timeline(scores):
    from ..functions.quality import classify_severity
    from ..operators.frames import stitch_ml_events

    # The score as measured decides the severity; two decimals of it are reported.
    scored = scores.withColumn("severity", classify_severity(F.col("score"), 35.0, 55.0, 75.0)).withColumn("score", F.round("score", 2))
    return stitch_ml_events(scored).select(*ML_COLUMNS)


_STRICT_LOUD = _LOUD.replace("from loudness l", "from (select file_id, 'strict' as profile, integrated_lufs, true_peak from loudness) l")

# Verdicts of every module by themselves: the single reports' checks, and the rules' for the rest.
_MODULE_SQL = {
    "validate_structure": f"select file_id, status, effective_status from ({CHECKS['structure_status']})",
    "validate_frames": f"select f.file_id, coalesce(r.status, 'PASSED') as status, null as effective_status from files f left join ({CHECKS['frames_report']}) r using (file_id)",
    "validate_analog": f"""select file_id, case when n > 10 then 'REJECTED' when n > 0 then 'WARNING' else 'PASSED' end, null from (
        with {RUN_SQL} select f.file_id, (select count(*) from vruns v where v.file_id = f.file_id) as n from (select distinct file_id from frames) f)""",
    "validate_black_freeze": f"""select f.file_id, case when bool_or(coalesce(r.type in ('video_freeze', 'black_frame_error'), false)) then 'REJECTED' else 'PASSED' end, null
        from (select file_id from logs union select file_id from qc_base) f left join ({CHECKS['black_freeze_report']}) r using (file_id) group by 1""",
    "validate_interlace": f"with {FIELD_SQL.format('pixels')} select file_id, case when avg_psnr > 0 and avg_psnr < 35 then 'WARNING' else 'PASSED' end, null from fields",
    "validate_artifacts": f"select file_id, status, null from ({CHECKS['artifacts_report']})",
    "validate_geometry": f"{_CROP} select file_id, case when pct > 1.0e0 and share < 0.75e0 then 'REJECTED' else 'PASSED' end, null from c",
    "validate_signal": f"""select file_id, case when m > 0 then 'REJECTED' else 'PASSED' end, null from (
        with {BURST_SQL} select f.file_id, (select count(*) from bursts b where b.file_id = f.file_id) as m from (select distinct file_id from frames) f)""",
    "validate_loudness": f"{_STRICT_LOUD} select file_id, status, case when status = 'REJECTED' then 'REJECTED' else 'PASSED' end from s",
    "validate_audio_signal": f"select file_id, status, null from ({CHECKS['audio_signal_report']})",
    "validate_phase": f"""select c.file_id, case when mean is null then 'WARNING' when mean < coalesce(p.min_phase_correlation, 0.0e0) then 'REJECTED' when low < -0.5e0 then 'WARNING' else 'PASSED' end, null
        from (select distinct file_id from logs) c left join (select file_id, avg(phase) as mean, min(phase) as low from audio_frames group by 1) m using (file_id)
        left join {PROFILE_SQL} p on p.profile = 'strict'""",
    "validate_avsync": f"select file_id, status, null from ({CHECKS['avsync_report']})",
}
_RUN_SQL = "with files as (select file_id from probes_flat union select file_id from frames union select file_id from pixels) " + " union all ".join(
    f"select f.file_id, '{name}' as module, coalesce(r.status, 'WARNING') as status, coalesce(r.effective_status, r.status, 'WARNING') as effective_status, {k} as ord"
    f" from files f left join (select * from ({sql}) t(file_id, status, effective_status)) r using (file_id)"
    for k, (name, sql) in enumerate(_MODULE_SQL.items())
)


@registered("run_checks", "frames", "pixels", "probes_flat", "crops", "loudness", "audio_frames", "logs", "qc_base", sql=_RUN_SQL)
def run_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve checks of every file in one run."""
    view = lambda name: load(spark, sf_dir, name)
    logs, base = view("logs"), view("qc_base")
    scores = base.select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("ord"), (F.floor(F.col("us") / 3600000) / 1000.0).alias("ts"),
        (F.col("cents") % 10000 / 100.0).alias("score"),
    )
    tables = {
        "frames": view("frames"), "pixels": view("pixels"), "logs": logs, "mono_logs": logs.withColumn("file_id", F.col("file_id") + 1),
        "channels": _channels(logs), "probes": nest_probes(view("probes_flat")), "bitrates": view("bitrates"), "scores": scores,
        "geometry": view("crops").withColumns({"sar": F.lit("1:1"), "dar": F.lit("0:1")}), "loudness": view("loudness"),
        "audio_frames": view("audio_frames"), "series": hourly(base),
        "durations": logs.select("file_id").union(base.select("file_id")).distinct().withColumn("duration_sec", F.lit(700.0)),
        "files": view("probes_flat").select("file_id").union(view("frames").select("file_id")).union(view("pixels").select("file_id")).distinct(),
    }
    registry = C.with_profiles(profiles_table(spark))

    # What the single reports' checks set otherwise than the defaults.
    def frames(t, mode):
        return C.frames_outcome(t, "duplicate_frame_count", max_changed=35)

    def avsync(t, mode):
        files, events = C.avsync_report(t["series"], t["durations"], mode, window=240)
        return C.Outcome(C._verdicts("validate_avsync", files), events, C._metrics("validate_avsync", files, "drift_ms"))

    own = {"validate_frames": frames, "validate_avsync": avsync, "validate_artifacts": lambda t, mode: registry["validate_artifacts"](t, "ott")}
    return C.run_checks({**registry, **own}, tables).verdicts

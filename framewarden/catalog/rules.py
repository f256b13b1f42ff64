"""Rule checks on measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import picture, sound, video
from ..fixtures import load
from ..functions.quality import classify_severity, valid_frame, violation_confidence
from ..operators.verdicts import contract_violations
from ..profiles import COLUMNS, DEFAULTS, join_profile, profiles_table, setting
from . import query
from .profile_rows import PROFILE_ROWS
from .scans import nest_probes, registered

PROFILE_SQL = f"(select * from ({PROFILE_ROWS}) as p({', '.join(c for c, _ in COLUMNS)}))"
KNOWN = "('strict', 'netflix_hd', 'youtube', 'ott')"


@query(
    "structure_metrics", "probes_flat",
    sql="""select file_id, case when header_ok then container end as container,
       case when header_ok then dur_tenths / 10.0e0 else 0.0e0 end as duration_sec,
       case when header_ok then bit_rate else 0 end as bitrate_bps,
       case when has_video then 1 else 0 end as track_count_video, n_audio as track_count_audio, n_subs as track_count_subs
       from probes_flat""",
)
def structure_metrics(flat):
    return picture.structure_metrics(nest_probes(flat)).select(
        "file_id", "container", "duration_sec", "bitrate_bps", "track_count_video", "track_count_audio", "track_count_subs"
    )


_MISMATCH = """(header_ok and has_video and dur_tenths > 0 and stream_tenths > 0
 and abs(dur_tenths / 10.0e0 - stream_tenths / 10.0e0) > 0.5e0)"""


@query(
    "duration_mismatch", "probes_flat",
    sql=f"select file_id, 'metadata_mismatch' as type from probes_flat where {_MISMATCH}",
)
def duration_mismatch(flat):
    return nest_probes(flat).where(picture.duration_mismatch()).select("file_id", F.lit("metadata_mismatch").alias("type"))


@query(
    "missing_language", "probes_flat",
    sql="""select file_id, 'video' as track from probes_flat where header_ok and mode = 'strict' and has_video and coalesce(v_lang, 'und') = 'und'
       union all select file_id, 'audio' from probes_flat where header_ok and mode = 'strict' and n_audio > 0 and coalesce(a_lang, 'und') = 'und'""",
)
def missing_language(flat):
    mode = F.col("mode")
    tracks = F.array_compact(
        F.array(*[F.when(picture.missing_language(k, mode), F.lit(k)) for k in ("video", "audio")])
    )
    return nest_probes(flat).where("header_ok").select("file_id", F.explode(tracks).alias("track"))


@query(
    "structure_status", "probes_flat",
    sql=f"""select file_id, case when header_ok and intact then 'PASSED' else 'REJECTED' end as status,
       case when not header_ok then 'PASSED' when not intact then 'REJECTED' when {_MISMATCH} then 'WARNING' else 'PASSED' end as effective_status
       from probes_flat""",
)
def structure_status(flat):
    return picture.structure_status(nest_probes(flat)).select("file_id", "status", "effective_status")


@query(
    "structure_events", "probes_flat",
    sql=f"""select file_id, 'corrupt_header' as type, 'Could not parse container header.' as details from probes_flat where not header_ok
       union all select file_id, 'metadata_mismatch', concat('Container duration (', printf('%d.%d', dur_tenths // 10, dur_tenths % 10),
         's) mismatches stream (', printf('%d.%d', stream_tenths // 10, stream_tenths % 10), 's).') from probes_flat where {_MISMATCH}
       union all select file_id, 'missing_metadata', 'Video track missing language tag.' from probes_flat
         where header_ok and mode = 'strict' and has_video and coalesce(v_lang, 'und') = 'und'
       union all select file_id, 'missing_metadata', 'Audio track missing language tag.' from probes_flat
         where header_ok and mode = 'strict' and n_audio > 0 and coalesce(a_lang, 'und') = 'und'
       union all select file_id, 'integrity_failure', 'Integrity Check Failed' from probes_flat where header_ok and not intact""",
)
def structure_events(flat):
    return picture.structure_events(nest_probes(flat), F.col("mode")).select("file_id", "type", "details")


_RATIO = """case when contains({0}, ':') then coalesce(try_cast(split_part({0}, ':', 1) as bigint) / nullif(try_cast(split_part({0}, ':', 2) as bigint), 0), 0.0e0)
 else coalesce(try_cast({0} as double), 0.0e0) end"""


@query(
    "aspect_ratio_check", "probes_flat",
    sql=f"""with r as (select *, {_RATIO.format('sar')} as s, {_RATIO.format('dar')} as d, width / height as shape from probes_flat)
       select file_id, round(case when s > 0 then shape * s else shape end, 4) as calculated_ratio,
       case when d > 0 and abs(d - case when s > 0 then shape * s else shape end) > 0.05e0 then 'WARNING' else 'PASSED' end as status from r""",
)
def aspect_ratio_check(flat):
    return picture.aspect_ratio_check(flat).select("file_id", F.round("calculated_ratio", 4).alias("calculated_ratio"), "status")


_CROP = """with c as (select *, act_w * act_h / (width * height) as share, 100.0e0 * (1.0e0 - act_w * act_h / (width * height)) as pct from crops)"""


@query(
    "active_area_check", "crops",
    sql=f"""{_CROP} select file_id, case when mode = 'strict' and pct > 1.0e0 and share < 0.75e0 then 'REJECTED' else 'PASSED' end as status,
       case when pct > 1.0e0 and act_h < height * 0.99e0 then 1 else 0 end as letterbox,
       case when pct > 1.0e0 and act_w < width * 0.99e0 then 1 else 0 end as pillarbox,
       case when pct > 1.0e0 and share < 0.75e0 then 1 else 0 end as small_area from c""",
)
def active_area_check(crops):
    found = {n: c.cast("int") for n, c in picture.active_area_findings().items()}
    checked = picture.active_area_check(crops, F.col("mode")).withColumns(found)
    return checked.select("file_id", "status", *found)


@query(
    "active_area_events", "crops",
    sql=f"""{_CROP} select file_id, 'letterbox_detected' as type from c where pct > 1.0e0 and act_h < height * 0.99e0
       union all select file_id, 'pillarbox_detected' from c where pct > 1.0e0 and act_w < width * 0.99e0
       union all select file_id, 'small_active_area' from c where pct > 1.0e0 and share < 0.75e0""",
)
def active_area_events(crops):
    return picture.active_area_events(crops).select("file_id", "type")


_LOUD = f"""with l as (select l.file_id, l.profile, l.integrated_lufs as v, l.true_peak,
  coalesce(p.integrated_loudness_target, -23.0e0) as target, coalesce(p.loudness_tolerance, 1.0e0) as tol, coalesce(p.true_peak_max, -1.0e0) as peak
  from loudness l left join {PROFILE_SQL} p on p.profile = case when l.profile in {KNOWN} then l.profile else 'strict' end),
 f as (select *, v = -99 as missing, v <> -99 and not (v between target - tol and target + tol) as off, v <> -99 and true_peak > peak as hot from l),
 s as (select *, case when missing then 'WARNING' when off or hot then 'REJECTED' else 'PASSED' end as status from f)"""


@registered(
    "loudness_check", "loudness",
    sql=f"""{_LOUD} select file_id, target, tol as tolerance, not off as loudness_ok, status,
       case when status = 'REJECTED' then 'REJECTED' else 'PASSED' end as effective_status from s""",
)
def loudness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = sound.loudness_check(load(spark, sf_dir, "loudness"), profiles_table(spark))
    return checked.select("file_id", "target", "tolerance", "loudness_ok", "status", "effective_status")


@registered(
    "true_peak_check", "loudness",
    sql=f"""{_LOUD} select file_id, true_peak, peak as peak_limit from s where hot""",
)
def true_peak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = sound.loudness_check(load(spark, sf_dir, "loudness"), profiles_table(spark))
    return checked.where(~F.col("peak_ok")).select("file_id", "true_peak", "peak_limit")


@registered(
    "loudness_events", "loudness",
    sql=f"""{_LOUD} select file_id, 'missing_audio' as type, 'medium' as severity from s where missing
       union all select file_id, 'loudness_violation', 'high' from s where off
       union all select file_id, 'true_peak_violation', 'high' from s where hot""",
)
def loudness_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sound.loudness_events(load(spark, sf_dir, "loudness"), profiles_table(spark)).select("file_id", "type", "severity")


@registered(
    "remediation_worklist", "loudness",
    sql=f"""{_LOUD} select file_id, v as integrated_lufs, -23.0e0 - v as gain_db from s where status = 'REJECTED'""",
)
def remediation_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = sound.loudness_check(load(spark, sf_dir, "loudness"), profiles_table(spark))
    return sound.remediation_worklist(checked).select("file_id", "integrated_lufs", "gain_db")


_AUDIO_FILES = "select user_id as file_id, max(abs(cents % 400 - 150)) / 200000.0e0 as dc_offset_max from qc_base group by 1"


def _by_user(base: DataFrame, kind, **more) -> DataFrame:
    start = F.floor(F.col("us") / 3600000) / 1000.0
    return base.select(
        F.col("user_id").alias("file_id"), kind.alias("type"), start.alias("start_time"),
        (start + F.floor(F.col("cents") / 4) / 1000.0).alias("end_time"), *[c.alias(n) for n, c in more.items()],
    )


_USER_SPAN = "(us // 3600000) / 1000.0e0 as start_time, (us // 3600000) / 1000.0e0 + (cents // 4) / 1000.0e0 as end_time"


@query(
    "audio_signal_status", "qc_base",
    sql=f"""with files as ({_AUDIO_FILES}),
       ev as (select user_id as file_id, case when event_type = 'error' and k < 50 then 'audio_dropout' else 'other' end as type,
         case when event_type = 'view' and k < 15 then 'CRITICAL' end as severity, {_USER_SPAN} from qc_base),
       g as (select file_id, bool_or(coalesce(severity = 'CRITICAL', false) or (type = 'audio_dropout' and end_time - start_time > 2.0e0)) as bad,
         bool_or(type = 'audio_dropout') as drp from ev group by 1)
       select f.file_id, case when coalesce(bad, false) then 'REJECTED' when coalesce(drp, false) or dc_offset_max > 0.001e0 then 'WARNING' else 'PASSED' end as status
       from files f left join g on g.file_id = f.file_id""",
)
def audio_signal_status(base):
    files = base.groupBy(F.col("user_id").alias("file_id")).agg(
        (F.max(F.abs(F.col("cents") % 400 - 150)) / 200000.0).alias("dc_offset_max")
    )
    kind = F.when((F.col("event_type") == "error") & (F.col("k") < 50), "audio_dropout").otherwise("other")
    critical = F.when((F.col("event_type") == "view") & (F.col("k") < 15), "CRITICAL")
    return sound.audio_signal_status(files, _by_user(base, kind, severity=critical)).select("file_id", "status")


_PHASE = f"""with m as (select a.file_id, case a.file_id % 5 when 0 then 'strict' when 1 then 'netflix_hd' when 2 then 'youtube' when 3 then 'ott' else 'archive' end as profile,
  avg(case when file_id % 17 <> 0 then phase end) as mean, min(case when file_id % 17 <> 0 then phase end) as low from audio_frames a group by 1)"""


@registered(
    "phase_status", "audio_frames",
    sql=f"""{_PHASE} select file_id, case when mean is null then 'WARNING' when mean < coalesce(p.min_phase_correlation, 0.0e0) then 'REJECTED'
       when low < -0.5e0 then 'WARNING' else 'PASSED' end as status
       from m left join {PROFILE_SQL} p on p.profile = case when m.profile in {KNOWN} then m.profile else 'strict' end""",
)
def phase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = load(spark, sf_dir, "audio_frames")
    f = F.col("file_id") % 5
    profile = F.when(f == 0, "strict").when(f == 1, "netflix_hd").when(f == 2, "youtube").when(f == 3, "ott").otherwise("archive")
    heard = frames.withColumn("phase", F.when(F.col("file_id") % 17 != 0, F.col("phase")))
    metrics = sound.phase_metrics(heard).withColumn("profile", profile)
    return sound.phase_status(metrics, profiles_table(spark)).select("file_id", "status")


@query(
    "bitrate_starvation", "bitrates",
    sql="""select file_id, bit_rate / (width * height) as bpp from bitrates
       where width > 0 and height > 0 and bit_rate / (width * height) < 0.02e0""",
)
def bitrate_starvation(bitrates):
    return video.bitrate_starvation(bitrates).select("file_id", "bpp")


@registered(
    "classify_severity", "frame_scores",
    sql=f"""select f.file_id, p.profile, f.ord, case when score < 0 then 'UNKNOWN' when score >= coalesce(severe, 70.0e0) then 'SEVERE'
       when score >= coalesce(moderate, 55.0e0) then 'MODERATE' when score >= coalesce(mild, 40.0e0) then 'MILD' else 'CLEAN' end as severity
       from (select *, case ord % 4 when 0 then 'strict' when 1 then 'netflix_hd' when 2 then 'youtube' else 'ott' end as profile,
         from (select file_id, ord, case when ord % 31 = 0 then -1.0e0 else score end as score from frame_scores)) f
       join {PROFILE_SQL} p on p.profile = f.profile""",
)
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ord") % 4
    profile = F.when(o == 0, "strict").when(o == 1, "netflix_hd").when(o == 2, "youtube").otherwise("ott")
    score = F.when(F.col("ord") % 31 == 0, F.lit(-1.0)).otherwise(F.col("score"))
    joined = join_profile(load(spark, sf_dir, "frame_scores").withColumn("profile", profile), profiles_table(spark))
    severity = classify_severity(score, setting("mild"), setting("moderate"), setting("severe"))
    return joined.select("file_id", "profile", "ord", severity.alias("severity"))


@query(
    "artifact_status", "qc_base",
    sql="""with ev as (select user_id as file_id, case when k = 0 then 'CRITICAL' when k = 1 then 'SEVERE' when k < 10 then 'WARNING'
         when k < 20 then 'MODERATE' when k < 80 then 'MILD' end as severity from qc_base)
       select file_id, case when bool_or(coalesce(severity in ('CRITICAL', 'SEVERE'), false)) then 'REJECTED'
       when bool_or(coalesce(severity in ('WARNING', 'MODERATE'), false)) then 'WARNING' else 'PASSED' end as status from ev group by 1""",
)
def artifact_status(base):
    k = F.col("k")
    severity = (
        F.when(k == 0, "CRITICAL").when(k == 1, "SEVERE").when(k < 10, "WARNING").when(k < 20, "MODERATE").when(k < 80, "MILD")
    )
    events = base.select(F.col("user_id").alias("file_id"), severity.alias("severity"))
    return video.artifact_status(events.select("file_id").distinct(), events).select("file_id", "status")


_FADES = """with d as (select file_id, max(end_time) as duration_sec from timeline group by 1),
 b as (select t.file_id, ord, case when start_time < 1.0e0 then 'fade_in' when end_time > duration_sec - 1.0e0 then 'fade_out' else 'black_frame_error' end as type
  from timeline t join d on d.file_id = t.file_id where t.type = 'click')"""


def _fades(timeline):
    ends = timeline.groupBy("file_id").agg(F.max("end_time").alias("duration_sec"))
    return video.fade_classify(timeline.where(F.col("type") == "click").join(ends, "file_id"))


@query("fade_classify", "timeline", sql=f"{_FADES} select file_id, ord, type from b")
def fade_classify(timeline):
    return _fades(timeline).select("file_id", "ord", "type")


@query(
    "black_freeze_status", "qc_base",
    sql="""select user_id as file_id, case when bool_or((event_type = 'click' and k < 15) or (event_type = 'view' and k < 10)) then 'REJECTED' else 'PASSED' end as status
       from qc_base group by 1""",
)
def black_freeze_status(base):
    kind = (
        F.when((F.col("event_type") == "click") & (F.col("k") < 15), "video_freeze")
        .when((F.col("event_type") == "view") & (F.col("k") < 10), "black_frame_error")
        .otherwise("fade_in")
    )
    events = _by_user(base, kind)
    return video.black_freeze_status(events.select("file_id").distinct(), events).select("file_id", "status")


@query(
    "violation_confidence", "frames",
    sql="""select file_id, frame_idx, round(least(abs(ymax - 235) / 20.0e0, 1.0e0), 2) as confidence_over, round(least(abs(ymin - 16) / 20.0e0, 1.0e0), 2) as confidence_under
       from frames""",
)
def confidence(frames):
    """Distance of both luma limits of every frame."""
    return frames.select(
        "file_id", "frame_idx", violation_confidence(F.col("ymax"), F.lit(235)).alias("confidence_over"),
        violation_confidence(F.col("ymin"), F.lit(16)).alias("confidence_under"),
    )


@query(
    "frame_status", "qc_base",
    sql="""with ev as (select user_id as file_id, case when k < 5 then 'non_monotonic_pts' when k < 8 then 'corrupt_packet'
         when k < 20 then 'frame_gap' else 'non_monotonic_dts' end as type from qc_base)
       select file_id, case when bool_or(type in ('non_monotonic_pts', 'corrupt_packet')) then 'REJECTED'
       when file_id % 40 > 24 or bool_or(type = 'frame_gap') then 'WARNING' else 'PASSED' end as status from ev group by 1""",
)
def frame_status(base):
    k = F.col("k")
    kind = F.when(k < 5, "non_monotonic_pts").when(k < 8, "corrupt_packet").when(k < 20, "frame_gap").otherwise("non_monotonic_dts")
    events = _by_user(base, kind)
    files = events.select("file_id").distinct().withColumn("duplicate_frame_count", F.col("file_id") % 40)
    return video.frame_status(files, events).select("file_id", "status")


@query(
    "analog_status", "orders",
    sql="""select o_orderkey as file_id, case when o_custkey % 15 > 10 then 'REJECTED' when o_custkey % 15 > 0 then 'WARNING' else 'PASSED' end as status from orders""",
)
def analog_status(orders):
    return orders.select(F.col("o_orderkey").alias("file_id"), video.analog_status(F.col("o_custkey") % 15).alias("status"))


@query(
    "signal_status", "qc_base",
    sql="""with f as (select user_id as file_id, count(*) filter (event_type <> 'view') as total,
         bool_or(k < 5) as bad, bool_or(k < 20) as hit from qc_base group by 1)
       select file_id, case when total = 0 then 'WARNING' when bad then 'REJECTED' when hit then 'WARNING' else 'PASSED' end as status from f""",
)
def signal_status(base):
    files = base.groupBy(F.col("user_id").alias("file_id")).agg(F.count_if(F.col("event_type") != "view").alias("total_frames"))
    severity = F.when(F.col("k") < 5, "REJECTED").otherwise("WARNING")
    bursts = _by_user(base.where(F.col("k") < 20), F.lit("broadcast_illegal_burst"), severity=severity)
    return video.signal_status(files, bursts).select("file_id", "status")


@query(
    "avsync_status", "orders",
    sql="""with o as (select o_orderkey as file_id, case when o_orderkey % 2 = 0 then 'strict' else 'ott' end as mode,
         (o_custkey % 120 - 60) / 1.0e0 as h, (o_custkey % 120 - 60) / 1.0e0 + (o_orderkey % 41 - 20) as t from orders)
       select file_id, greatest(abs(h), abs(t)) as max_offset_ms, t - h as drift_ms,
       case when greatest(abs(h), abs(t)) > 40.0e0 then case when mode = 'strict' then 'REJECTED' else 'WARNING' end
       when abs(t - h) > 15.0e0 then 'WARNING' else 'PASSED' end as status from o""",
)
def avsync_status(orders):
    head = (F.col("o_custkey") % 120 - 60).cast("double")
    offsets = orders.select(
        F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 2 == 0, "strict").otherwise("ott").alias("mode"),
        head.alias("offset_head_ms"), (head + (F.col("o_orderkey") % 41 - 20)).alias("offset_tail_ms"),
    ).withColumn("drift_ms", F.col("offset_tail_ms") - F.col("offset_head_ms"))
    return video.avsync_status(offsets, F.col("mode")).select("file_id", "max_offset_ms", "drift_ms", "status")


@query(
    "interlace_status", "orders",
    sql="""select o_orderkey as file_id, case when o_orderkey % 9 = 0 then case when o_orderkey % 2 = 0 then 'REJECTED' else 'WARNING' end
       when o_custkey % 50 > 0 and o_custkey % 50 < 35 then 'WARNING' else 'PASSED' end as status from orders""",
)
def interlace_status(orders):
    metrics = orders.select(
        F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 2 == 0, "strict").otherwise("ott").alias("mode"),
        (F.col("o_orderkey") % 9 == 0).alias("has_events"), (F.col("o_custkey") % 50).cast("double").alias("avg_psnr"),
    )
    return video.interlace_status(metrics, F.col("mode")).select("file_id", "status")


_KEYS = ("module", "video_file", "status", "metrics", "events")


@query(
    "contract_violations", "mixed_reports",
    sql="""with r as (select file_id, ord, status, n_events,
         (case when has_video_file then 0 else 1 end) + (case when has_metrics then 0 else 1 end) + (case when status is null then 1 else 0 end) as gone
         from mixed_reports), v as (select *, case when gone > 0 then 'missing_keys' when status not in ('PASSED', 'WARNING', 'REJECTED', 'ERROR') then 'invalid_status'
         when status <> 'PASSED' and n_events = 0 then 'no_events' end as violation from r)
       select file_id, ord, gone as n_missing, violation from v where violation is not null""",
)
def contract(reports):
    there = {"video_file": F.col("has_video_file"), "metrics": F.col("has_metrics"), "status": F.col("status").isNotNull()}
    keys = F.array_compact(F.array(*[F.when(there.get(k, F.lit(True)), F.lit(k)) for k in _KEYS]))
    broken = contract_violations(reports.withColumn("present_keys", keys))
    return broken.select("file_id", "ord", F.size("missing").alias("n_missing"), "violation")


@query(
    "valid_frame_filter", "textured",
    sql="""with s as (select file_id, frame_idx, width, len(px) // width as height, list_sum(px) as s, list_sum(list_transform(px, lambda x: x * x)) as ss, len(px) as n from textured)
       select file_id, frame_idx from s where width >= 8 and height >= 8 and ss / n - (s / n) * (s / n) >= 2480.0e0""",
)
def valid_frame_filter(pixels):
    """Size and texture limits scaled to the small test pictures."""
    return pixels.where(valid_frame(F.col("px"), F.col("width"), 8, 2480.0)).select("file_id", "frame_idx")


@registered(
    "resolve_profile", "mixed_reports",
    sql=f"""select m.file_id, m.ord, coalesce(p.profile, s.profile) as resolved_profile,
       coalesce(case when p.profile is not null then p.loudness_tolerance else s.loudness_tolerance end, {DEFAULTS['loudness_tolerance']}e0) as tolerance,
       coalesce(case when p.profile is not null then p.moderate else s.moderate end, {DEFAULTS['moderate']}e0) as moderate
       from mixed_reports m left join {PROFILE_SQL} p on p.profile = m.profile, {PROFILE_SQL} s where s.profile = 'strict'""",
)
def resolve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_profile(load(spark, sf_dir, "mixed_reports"), profiles_table(spark))
    return joined.select(
        "file_id", "ord", "resolved_profile", setting("loudness_tolerance").alias("tolerance"), setting("moderate").alias("moderate")
    )


@registered(
    "join_profile", "mixed_reports",
    sql=f"""select m.file_id, m.ord, m.profile, p.integrated_loudness_target, p.tolerance_ms, p.threshold_score
       from mixed_reports m join {PROFILE_SQL} p on p.profile = case when m.profile = 'archive' then 'strict' else m.profile end""",
)
def join_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_profile(load(spark, sf_dir, "mixed_reports"), profiles_table(spark))
    return joined.select("file_id", "ord", "profile", "integrated_loudness_target", "tolerance_ms", "threshold_score")

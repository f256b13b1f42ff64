"""Whole checks: from measurement tables to verdicts and events, and their registry.

Verdicts and events are lazy: nothing runs while a check is put together.

Every check takes the tables it needs and returns ``Outcome(verdicts, events)``:
verdicts ``file_id, module, status, effective_status`` and events ``file_id,
module, type, start_time, end_time, severity, details``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import picture, sound, video
from ..checks.base import PASSED, WARNING, event, list_events
from ..functions import logs as L
from ..functions.quality import classify_severity
from ..operators import frames as fr
from ..operators import lag
from ..operators.density import broadcast_bursts
from ..operators.intervals import overlap_anti_join, pair_start_end
from ..profiles import join_profile, setting, with_profile

EVENT_COLUMNS = ("type", "start_time", "end_time", "severity", "details")


@dataclass(frozen=True)
class Outcome:
    """``metrics``: ``file_id, module, metrics``, a map of the numbers a report states.

    ``otherwise`` is the verdict of a file that ``verdicts`` do not know.
    """

    verdicts: DataFrame
    events: DataFrame
    metrics: DataFrame
    otherwise: str = WARNING


Tables = dict[str, DataFrame]


def _events(module: str, *parts: DataFrame) -> DataFrame:
    out = None
    for df in parts:
        kinds = {"type": "string", "start_time": "double", "end_time": "double", "severity": "string", "details": "string"}
        full = df.select(
            "file_id",
            F.lit(module).alias("module"),
            *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()],
        )
        out = full if out is None else out.unionByName(full)
    return out


def _metrics(module: str, df: DataFrame, *names: str) -> DataFrame:
    """The named columns as one map; what is null is left out."""
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    present = F.map_filter(values, lambda _, v: v.isNotNull()) if names else F.create_map().cast("map<string,double>")
    return df.select("file_id", F.lit(module).alias("module"), present.alias("metrics"))


def _verdicts(module: str, df: DataFrame) -> DataFrame:
    effective = F.col("effective_status") if "effective_status" in df.columns else F.col("status")
    return df.select("file_id", F.lit(module).alias("module"), "status", effective.alias("effective_status"))


def check_structure(t: Tables, mode: str = "strict") -> Outcome:
    name = "validate_structure"
    measured = picture.structure_metrics(t["probes"])
    return Outcome(
        _verdicts(name, picture.structure_status(t["probes"])),
        _events(name, picture.structure_events(t["probes"], mode)),
        _metrics(name, measured, "duration_sec", "bitrate_bps", "track_count_video", "track_count_audio", "track_count_subs"),
    )


def check_geometry(t: Tables, mode: str = "strict") -> Outcome:
    """``geometry``: ``file_id, width, height, sar, dar, act_w, act_h``."""
    name = "validate_geometry"
    aspect = picture.aspect_ratio_check(t["geometry"])
    checked = picture.active_area_check(aspect, mode, prior=F.col("status"))
    distorted = list_events(aspect.where(F.col("status") == "WARNING"), event(
        "ar_distortion",
        F.format_string("Metadata DAR (%.2f) mismatch with Resolution-based DAR (%.2f).", "display_ratio", "calculated_ratio"),
    ))
    return Outcome(
        _verdicts(name, checked), _events(name, distorted, picture.active_area_events(t["geometry"])),
        _metrics(name, checked, "display_ratio", "calculated_ratio", "blanking_pct"),
    )


def frames_report(t: Tables, fps: float = 25.0, max_changed: int = 50) -> tuple[DataFrame, DataFrame]:
    """Verdict with metrics per file, and events, of the frame continuity check.

    ``logs``, ``pixels`` (``frame_idx, px``) and ``frames`` (``frame_idx, pts_us``).
    """
    errors = L.log_errors(t["logs"])
    frames = t["frames"]
    # Pixels travel once; the times join the narrow flags afterwards.
    flags = fr.mark_duplicates(t["pixels"].select("file_id", "frame_idx", "px"), max_changed)
    marked = flags.join(frames.select("file_id", "frame_idx", "pts_us"), ["file_id", "frame_idx"])
    drift = fr.max_pts_drift(frames, fps)
    events = _events("validate_frames", errors, fr.frame_gaps(frames, fps), fr.freeze_runs(marked, fps), fr.drift_events(drift))
    # A file counts as soon as one of the tables knows it.
    known = [t[name].select("file_id") for name in ("frames", "pixels", "logs")]
    every = t["files"].select("file_id") if "files" in t else known[0].union(known[1]).union(known[2]).distinct()
    files = (
        every.join(drift, "file_id", "left").join(fr.duplicate_count(flags), "file_id", "left")
        .withColumn("duplicate_frame_count", F.coalesce("duplicate_frame_count", F.lit(0)))
        .withColumn("max_pts_drift_ms", F.round(F.coalesce("max_pts_drift_ms", F.lit(0.0)), 2))
    )
    return video.frame_status(files, events), events


def frames_outcome(t: Tables, *names: str, **limits) -> Outcome:
    """The frame continuity check; a file that no table knows has no fault, so its verdict needs no row."""
    name = "validate_frames"
    files, events = frames_report(t, **limits)
    known, _ = frames_report({k: v for k, v in t.items() if k != "files"}, **limits)
    return Outcome(_verdicts(name, known), events, _metrics(name, files, *names), PASSED if "files" in t else WARNING)


def check_frames(t: Tables, mode: str = "strict") -> Outcome:
    return frames_outcome(t, "duplicate_frame_count", "max_pts_drift_ms")


def check_analog(t: Tables, mode: str = "strict") -> Outcome:
    name = "validate_analog"
    runs = fr.vrep_runs(t["frames"])
    counts = fr.vrep_spike_count(t["frames"], runs)
    found = runs.select("file_id", "details", F.col("timestamp").alias("start_time"))
    checked = counts.withColumn("status", video.analog_status(F.col("vrep_spikes")))
    return Outcome(_verdicts(name, checked), _events(name, found), _metrics(name, counts, "vrep_spikes"))


def check_signal(t: Tables, mode: str = "strict") -> Outcome:
    name = "validate_signal"
    bursts = broadcast_bursts(t["frames"], mode)
    files = video.signal_status(video.signal_metrics(t["frames"]), bursts)
    names = ("signal_min_y", "signal_max_y", "broadcast_illegal_frames", "saturation_warnings", "total_frames")
    return Outcome(_verdicts(name, files), _events(name, bursts), _metrics(name, files, *names))


def check_black_freeze(t: Tables, mode: str = "strict") -> Outcome:
    """``logs`` and ``durations`` (``file_id, duration_sec``)."""
    name = "validate_black_freeze"
    black = video.fade_classify(L.parse_black(t["logs"]).join(t["durations"], "file_id", "left"))
    words = (
        F.when(F.col("type") == "fade_in", F.lit("Intentional Fade-In detected."))
        .when(F.col("type") == "fade_out", F.lit("Intentional Fade-Out detected."))
        .otherwise(F.concat(F.lit("Unexpected Black Screen for "), F.col("duration").cast("string"), F.lit("s.")))
    )
    frozen = pair_start_end(L.parse_freeze(t["logs"]).select("file_id", "line_no", "kind", "at"), ["file_id"])
    length = F.round(F.col("end_time") - F.col("start_time"), 2).cast("string")
    frozen = frozen.withColumns({
        "type": F.lit("video_freeze"),
        "details": F.concat(F.lit("Video Freeze detected for "), length, F.lit("s.")),
    })
    events = _events(name, black.withColumn("details", words), frozen)
    # A file without a known length has a verdict too.
    every = t["durations"].select("file_id").union(t["logs"].select("file_id")).distinct()
    files = video.black_freeze_status(every, events)
    return Outcome(_verdicts(name, files), events, _metrics(name, files))


def check_interlace(t: Tables, mode: str = "strict") -> Outcome:
    name = "validate_interlace"
    metrics = fr.field_metrics(t["pixels"])
    checked = video.interlace_status(metrics.withColumn("has_events", F.lit(False)), mode)
    warned = list_events(
        checked.where(F.col("status") == "WARNING"),
        event("global_interlace_warning", F.format_string(
            "Low average Field PSNR (%.2f dB). Content appears globally interlaced.", "avg_psnr"), F.lit(0.0), F.lit(0.0)),
    )
    return Outcome(_verdicts(name, checked), _events(name, warned), _metrics(name, checked, "avg_psnr"))


def artifacts_report(t: Tables, profiles: DataFrame, profile: str | Column = "strict") -> tuple[DataFrame, DataFrame]:
    """``bitrates`` (one row per file) and ``scores`` (``file_id, ts, ord, score``)."""
    if isinstance(profile, str):
        rows = with_profile(t["scores"], profiles, profile)
    else:
        rows = join_profile(t["scores"].withColumn("profile", profile), profiles)
    scored = (
        rows.where(setting("ml_enabled") & (F.col("score") >= 0))
        # The score as measured decides the severity; two decimals of it are reported.
        .withColumn("severity", classify_severity(F.col("score"), setting("mild"), setting("moderate"), setting("severe")))
        .withColumn("score", F.round("score", 2))
        .withColumn("min_duration", setting("min_duration_sec"))
        .select("file_id", "min_duration", "ts", "ord", "score", "severity")
    )
    stitched = fr.stitch_ml_events(scored, "min_duration")
    events = _events("validate_artifacts", video.bitrate_events(t["bitrates"]), stitched)
    files = t["bitrates"].select("file_id").join(video.quality_metrics(scored), "file_id", "left")
    return video.artifact_status(files, events), events


def audio_signal_report(t: Tables) -> tuple[DataFrame, DataFrame]:
    """``logs`` of the source, ``mono_logs`` of the channel sum, ``channels`` per file."""
    source = L.parse_silence(t["logs"]).select("file_id", "start", "end")
    live = t["channels"].where(F.col("channels") > 0).select("file_id")
    stereo = t["channels"].where(F.col("channels") >= 2).select("file_id")
    mono = L.parse_silence(t["mono_logs"]).select("file_id", "start", "end").join(stereo, "file_id", "left_semi")
    length = F.format_string("%.2f", F.col("end") - F.col("start"))
    dropouts = source.join(live, "file_id", "left_semi").select(
        "file_id", F.lit("audio_dropout").alias("type"),
        F.concat(F.lit("Audio Silence detected ("), length, F.lit("s).")).alias("details"),
        F.col("start").alias("start_time"), F.col("end").alias("end_time"),
    )
    cancelled = overlap_anti_join(mono, source, ["file_id"]).select(
        "file_id", F.lit("phase_inversion_detected").alias("type"),
        F.concat(F.lit("Phase Cancellation detected ("), length, F.lit("s). L+R Sum resulted in silence.")).alias("details"),
        F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.lit("CRITICAL").alias("severity"),
    )
    metrics = t["channels"].join(sound.audio_metrics(t["logs"]), "file_id", "left").withColumns({
        "dc_offset_max": F.when(F.col("channels") > 0, F.coalesce("dc_offset_max", F.lit(0.0))).otherwise(0.0),
        "dynamic_range_db": F.when(F.col("channels") > 0, F.coalesce("dynamic_range_db", F.lit(0.0))).otherwise(0.0),
        "peak_volume_db": F.when(F.col("channels") > 0, F.coalesce("peak_volume_db", F.lit(-99.0))).otherwise(-99.0),
    })
    high = list_events(
        metrics.where(F.col("dc_offset_max") > 0.001),
        event("dc_offset_warn", F.format_string("DC Offset %.6f is high.", "dc_offset_max")),
    )
    events = _events("validate_audio_signal", dropouts, cancelled, high)
    return sound.audio_signal_status(metrics, events), events


def check_audio_signal(t: Tables, mode: str = "strict") -> Outcome:
    files, events = audio_signal_report(t)
    name = "validate_audio_signal"
    return Outcome(_verdicts(name, files), events, _metrics(name, files, "dc_offset_max", "dynamic_range_db", "peak_volume_db"))


def avsync_report(series: DataFrame, durations: DataFrame, mode: str | Column = "strict", *, window: int) -> tuple[DataFrame, DataFrame]:
    """``series``: ``file_id, i, a, v`` per analysis step; the first and last ``window`` steps count.

    Both series are scaled within each window.  A file without a known length
    has a verdict too.
    """
    offsets = lag.head_tail_drift(series, window, scale=True).join(durations, "file_id", "left")
    checked = video.avsync_status(offsets, mode)
    events = _events("validate_avsync", video.avsync_events(checked))
    rounded = {c: F.round(c, 2) for c in ("offset_head_ms", "offset_tail_ms", "drift_ms", "max_offset_ms")}
    files = checked.withColumns({**rounded, "confidence_score": F.round("confidence_head", 2)})
    return files, events


def check_avsync(t: Tables, mode: str = "strict") -> Outcome:
    files, events = avsync_report(t["series"], t["durations"], mode, window=lag.WINDOW_STEPS)
    name = "validate_avsync"
    names = ("offset_head_ms", "offset_tail_ms", "drift_ms", "max_offset_ms", "confidence_score")
    return Outcome(_verdicts(name, files), events, _metrics(name, files, *names))


# Checks that need only measurement tables; the profile-driven ones are bound by
# ``with_profiles``.
CHECKS: dict[str, Callable[[Tables, str], Outcome]] = {
    "validate_structure": check_structure,
    "validate_frames": check_frames,
    "validate_analog": check_analog,
    "validate_black_freeze": check_black_freeze,
    "validate_interlace": check_interlace,
    "validate_geometry": check_geometry,
    "validate_signal": check_signal,
    "validate_audio_signal": check_audio_signal,
    "validate_avsync": check_avsync,
}


def with_profiles(profiles: DataFrame) -> dict[str, Callable[[Tables, str], Outcome]]:
    """All twelve checks."""

    def artifacts(t: Tables, mode: str = "strict") -> Outcome:
        files, events = artifacts_report(t, profiles, mode)
        name = "validate_artifacts"
        return Outcome(_verdicts(name, files), events, _metrics(name, files, "frames_analyzed", "avg_quality_score", "worst_score"))

    def loudness(t: Tables, mode: str = "strict") -> Outcome:
        measured = t["loudness"].withColumn("profile", F.lit(mode))
        return Outcome(
            _verdicts("validate_loudness", sound.loudness_check(measured, profiles)),
            _events("validate_loudness", sound.loudness_events(measured, profiles)),
            _metrics("validate_loudness", measured, "integrated_lufs", "true_peak"),
        )

    def phase(t: Tables, mode: str = "strict") -> Outcome:
        metrics = sound.phase_metrics(t["audio_frames"]).withColumn("profile", F.lit(mode))
        if "channels" in t:
            every = t["channels"].select("file_id").withColumn("profile", F.lit(mode))
            metrics = every.join(metrics, ["file_id", "profile"], "left")
        checked = sound.phase_status(metrics, profiles)
        none = checked.where(F.lit(False)).withColumn("type", F.lit(None).cast("string")).select("file_id", "type")
        numbers = _metrics("validate_phase", checked, "mean_phase_correlation", "min_phase_correlation")
        return Outcome(_verdicts("validate_phase", checked), _events("validate_phase", none), numbers)

    return {**CHECKS, "validate_artifacts": artifacts, "validate_loudness": loudness, "validate_phase": phase}


# The checks a complete run consists of, in order.
MODULES = (
    "validate_structure",
    "validate_frames",
    "validate_analog",
    "validate_black_freeze",
    "validate_interlace",
    "validate_artifacts",
    "validate_geometry",
    "validate_signal",
    "validate_loudness",
    "validate_audio_signal",
    "validate_phase",
    "validate_avsync",
)


def run_checks(registry: dict[str, Callable[[Tables, str], Outcome]], tables: Tables, mode: str = "strict", modules=MODULES) -> Outcome:
    """Union of the named checks' outcomes, numbered in the given order.

    With a table ``files`` every file has a verdict of every module: the
    outcome's ``otherwise`` where the module's tables know nothing of it.  All
    modules' verdicts meet the files in one shuffle, at most a few rows a file.
    """
    verdicts = events = metrics = None
    otherwise = []
    for position, name in enumerate(modules):
        out = registry[name](tables, mode)
        otherwise.append(out.otherwise)
        v = out.verdicts.withColumn("ord", F.lit(position))
        verdicts = v if verdicts is None else verdicts.unionByName(v)
        events = out.events if events is None else events.unionByName(out.events)
        metrics = out.metrics if metrics is None else metrics.unionByName(out.metrics)
    if "files" in tables:
        verdicts = _of_every_file(tables["files"], verdicts, modules, otherwise)
    return Outcome(verdicts, events, metrics)


def _of_every_file(files: DataFrame, verdicts: DataFrame, modules: Sequence[str], otherwise: Sequence[str]) -> DataFrame:
    """The verdicts of each file and module, one made up for those that have none."""
    listed = -1
    known = verdicts.where(F.col("file_id").isNotNull()).select("file_id", "ord", "status", "effective_status")
    marks = files.select("file_id", F.lit(listed).alias("ord"), *[F.lit(None).cast("string").alias(c) for c in ("status", "effective_status")])
    found = known.unionByName(marks).groupBy("file_id").agg(F.collect_list(F.struct("ord", "status", "effective_status")).alias("_found"))

    def of(position: int) -> Column:
        own = F.filter("_found", lambda v: v["ord"] == position)
        words = F.lit(otherwise[position])
        none = F.array(F.struct(F.lit(position).alias("ord"), words.alias("status"), words.alias("effective_status")))
        filled = F.transform(own, lambda v: F.struct(
            v["ord"].alias("ord"), *[F.coalesce(v[c], F.lit(WARNING)).alias(c) for c in ("status", "effective_status")]
        ))
        return F.when(F.size(own) > 0, filled).otherwise(none)

    each = found.where(F.exists("_found", lambda v: v["ord"] == listed)).select(
        "file_id", F.inline(F.flatten(F.array(*[of(k) for k in range(len(modules))])))
    )
    names = F.array(*[F.lit(m) for m in modules])
    return each.select("file_id", F.element_at(names, F.col("ord") + 1).alias("module"), "status", "effective_status", "ord")


def report_rows(outcome: Outcome) -> DataFrame:
    """One row a report: verdict, ``metrics``, ``n_events`` and ``present_keys``, as the contract check reads them.

    Events stay rows of their own.
    """
    counts = outcome.events.groupBy("file_id", "module").agg(F.count(F.lit(1)).alias("n_events"))
    rows = outcome.verdicts.join(outcome.metrics, ["file_id", "module"], "left").join(counts, ["file_id", "module"], "left")
    keys = ("module", "video_file", "status", "metrics", "events")
    return rows.withColumns({
        "metrics": F.coalesce("metrics", F.create_map().cast("map<string,double>")),
        "n_events": F.coalesce("n_events", F.lit(0)), "present_keys": F.array(*[F.lit(k) for k in keys]),
    })


def segment_values(reports: DataFrame) -> DataFrame:
    """``file_id, segment_id, module, key, v`` of reports of segments, for folding their metrics."""
    return reports.select("file_id", "segment_id", "module", F.explode("metrics").alias("key", "v"))

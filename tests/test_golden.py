"""Small cases with known results."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from framewarden import profiles
from framewarden.checks import sound, video
from framewarden.functions import logs as L
from framewarden.functions import timecode as T
from framewarden.functions import wording as W
from framewarden.functions.quality import (
    classify_severity,
    field_sums,
    psnr,
    ssim,
    valid_frame,
    violation_confidence,
)
from framewarden.operators.frames import sample_every_nth, sampling_step
from framewarden.operators.grading import calibration_signal, grade_cases, system_accuracy
from framewarden.operators.segments import merge_segment_details, plan_segments
from framewarden.plans import checks as C
from framewarden.plans.master import master_report, segmented_master


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def column_of(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_confidence(spark):
    assert column_of(spark, [235, 245, 255, 275], "int", lambda v: violation_confidence(v, F.lit(235))) == [0.0, 0.5, 1.0, 1.0]


def test_severity_bands(spark):
    got = column_of(spark, [10.0, 45.0, 60.0, 85.0, -1.0], "double", classify_severity)
    assert got == ["CLEAN", "MILD", "MODERATE", "SEVERE", "UNKNOWN"]


def test_similarity_and_psnr(spark):
    flat, dark = F.array_repeat(F.lit(128), 10000), F.array_repeat(F.lit(0), 10000)
    same = one(spark, ssim(field_sums(flat, flat)))
    assert same == pytest.approx(1.0)
    assert one(spark, ssim(field_sums(flat, dark))) < 0.1
    assert one(spark, psnr(F.lit(0.0))) == 100.0
    assert one(spark, psnr(F.lit(255.0 * 255.0))) == pytest.approx(0.0)


def test_flat_frame_is_rejected(spark):
    assert one(spark, valid_frame(F.array_repeat(F.lit(0), 720 * 64), F.lit(64))) is False
    noisy = F.transform(F.sequence(F.lit(0), F.lit(64 * 64 - 1)), lambda i: (i * 37 % 256).cast("int"))
    assert one(spark, valid_frame(noisy, F.lit(64))) is True
    assert one(spark, valid_frame(noisy, F.lit(16))) is False


def test_sampler(spark):
    frames = spark.range(2000).select(F.lit(1).alias("file_id"), F.col("id").alias("frame_idx"))
    assert sample_every_nth(frames, 5, first_seconds=30, fps=25).count() == 151
    assert column_of(spark, [24.0, 25.0, 0.4, 2.5], "double", lambda v: sampling_step(v, F.lit(1.0))) == [24, 25, 1, 2]
    # Halves go to the even step.
    assert column_of(spark, [25.0, 27.0], "double", lambda v: sampling_step(v, F.lit(2.0))) == [12, 14]


def test_timecodes(spark):
    assert column_of(spark, [0.0, 3661.5, None, 59.99], "double", T.seconds_to_smpte) == [
        "00:00:00:00", "01:01:01:12", "00:00:00:00", "00:00:59:23"]
    assert column_of(spark, ["01:01:01:12", "", "1:2:3", None, "a:b:c:d"], "string", T.smpte_to_seconds) == [3661.5, 0.0, 0.0, 0.0, 0.0]
    assert column_of(spark, ["16:9", "4:0", "1.5", "N/A", None], "string", T.parse_ratio) == [16 / 9, 0.0, 1.5, 0.0, 0.0]
    assert column_of(spark, ["x time=01:02:03.50 y", "none"], "string", T.clock_to_seconds) == [3723.5, 0.0]


def test_names_follow_python_title(spark):
    words = ["black_frame_error", "peak2x_drift", "av_sync_error", "a1b_2c", "it's_odd", "unknown"]
    assert column_of(spark, words, "string", W.human_name) == [w.replace("_", " ").title() for w in words]


def test_log_lines(spark):
    lines = [
        "[silencedetect] silence_end: 15.0 | silence_duration: 2.5",
        "[silencedetect] silence_end: x | silence_duration: 2.5",
        "[blackdetect @ 0x1] black_start:12.5 black_end:15.5 black_duration:3.0",
        "lavfi.freezedetect.freeze_start: 4.5",
        "  I:         -23.1 LUFS",
        "  LRA:         5.2 LU",
        "  True peak:  -1.5 oops -1.2 dBTP",
        "  I:         -22.0 LUFS",
        "crop=1920:800:0:140 crop=1904:800:8:140",
        "DTS 5 < 6 time=00:00:02.00 and pts 1 < 2",
    ]
    logs = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_id string, line_no long, line string")
    assert [(r.start, r.end) for r in L.parse_silence(logs).collect()] == [(12.5, 15.0)]
    assert [(r.start_time, r.end_time, r.duration) for r in L.parse_black(logs).collect()] == [(12.5, 15.5, 3.0)]
    assert [(r.kind, r.at) for r in L.parse_freeze(logs).collect()] == [("start", 4.5)]
    loud = L.parse_loudness_summary(logs).first()
    assert (loud.integrated_lufs, loud.lra, loud.true_peak) == (-22.0, 5.2, -1.2)
    assert tuple(L.last_crop(logs).first()) == ("f", 1904, 800, 8, 140)
    assert sorted((r.type, r.start_time) for r in L.log_errors(logs).collect()) == [
        ("non_monotonic_dts", 2.0), ("non_monotonic_pts", 2.0)]
    progress = spark.createDataFrame(
        [(1, 0, "[PROGRESS] 25 - Checking Video Frames"), (1, 1, "[PROGRESS] 30"), (1, 2, "noise")],
        "job_id int, line_no long, line string",
    )
    assert tuple(L.parse_progress(progress).first()) == (1, 30, "Checking Video Frames")


def test_loudnorm_block(spark):
    block = '{"input_i": "-23.0", "input_tp": "-1.5", "input_lra": "7.0", "input_thresh": "-33.0"}'
    docs = [("a", f"log {{x}}\n{block}\nend"), ("b", "no block"), ("c", "} reversed {"), ("d", "{ bad json }")]
    got = L.parse_loudnorm(spark.createDataFrame(docs, "file_id string, log string")).collect()
    assert [tuple(r) for r in got if r.input_i is not None] == [("a", -23.0, -1.5, 7.0, -33.0)]
    assert {r.file_id for r in got} <= {"a", "d"}


def test_config_hash_is_stable():
    text = json.dumps(profiles.PROFILES["ott"], sort_keys=True)
    assert text.startswith('{"audio": {"integrated_loudness_target": -24.0}, "description": ')
    assert profiles.config_hash("nobody") == profiles.config_hash("strict")
    assert {p: profiles.config_hash(p) for p in profiles.PROFILES} == {
        "strict": "2a39001b", "netflix_hd": "785f84ea", "youtube": "6bbd4585", "ott": "3e7a05c8",
    }


def test_profile_fallbacks(spark):
    asked = spark.createDataFrame([("ott",), ("strict",), ("??",)], "profile string")
    joined = profiles.join_profile(asked, profiles.profiles_table(spark))
    got = {r.profile: (r.t, r.p, r.s) for r in joined.select(
        "profile", profiles.setting("loudness_tolerance").alias("t"), profiles.setting("true_peak_max").alias("p"),
        profiles.setting("severe").alias("s")).collect()}
    assert got == {"ott": (1.0, -1.0, 70.0), "strict": (1.0, -1.0, 75.0), "??": (1.0, -1.0, 75.0)}


def test_calibration_records(spark):
    rows = [("clean", i, v, 16, 235) for i, v in enumerate([1.0, 2.0])] + [
        ("dropout", i, v, 5, 240) for i, v in enumerate([55.0, 6.0, 1.0])]
    got = {r.file_id: r for r in calibration_signal(
        spark.createDataFrame(rows, "file_id string, frame_idx long, vrep double, ymin int, ymax int")).collect()}
    assert (got["clean"].vrep_max, got["clean"].vrep_spike_count) == (2.0, 0)
    assert (got["dropout"].vrep_spike_count, got["dropout"].ymin_min, got["dropout"].ymax_max) == (2, 5, 240)


def test_nested_events_survive_the_segment_fold(spark):
    reports = spark.createDataFrame([("f", 0, "validate_black_freeze", "REJECTED")],
                                    "file_id string, segment_id int, module string, status string")
    events = spark.createDataFrame([("f", 0, 0, "black_frame", 2.0, 5.0, None, "x")],
                                   "file_id string, segment_id int, ord long, type string, start_time double, end_time double, severity string, details string")
    values = spark.createDataFrame([("f", 0, "m", "mean_phase", 0.5)], "file_id string, segment_id int, module string, key string, v double")
    segments = spark.createDataFrame([("f", 0, 60.0)], "file_id string, segment_id int, start_time double")
    out = segmented_master(reports, events, values, segments)
    assert [(r.type, r.start_time, r.end_time) for r in out["events"].collect()] == [("black_frame", 62.0, 65.0)]
    assert out["files"].first().status == "REJECTED"


def test_segment_details_fold_in_order(spark):
    values = [(7, 4.0), (1, 1.0), (9, 3.0), (4, 8.0), (8, -2.0)]
    rows = [("f", "m", k, s, v) for k in ("mean_phase_correlation", "min_phase_correlation", "Sync_OFFSET", "codec") for s, v in values]
    got = {r.key: r.v for r in merge_segment_details(
        spark.createDataFrame(rows, "file_id string, module string, key string, segment_id long, v double"), chunk_rows=3).collect()}
    mean = None
    for _, v in sorted(values):
        mean = v if mean is None else (mean + v) / 2
    assert got == {"mean_phase_correlation": mean, "min_phase_correlation": -2.0, "Sync_OFFSET": 8.0, "codec": 1.0}


def test_plan_segments(spark):
    files = spark.createDataFrame([("a", 610.0), ("b", 0.0), ("c", 300.0)], "file_id string, duration_sec double")
    got = sorted(tuple(r) for r in plan_segments(files).collect())
    assert got == [("a", 0, 0.0, 300.0), ("a", 1, 300.0, 300.0), ("a", 2, 600.0, 10.0), ("c", 0, 0.0, 300.0)]


def test_grading(spark):
    plan = spark.createDataFrame([
        ("ref", ["PASSED", "WARNING"], []), ("black", ["REJECTED", "WARNING"], ["black_frame", "freeze_frame"]),
        ("loud", ["REJECTED"], ["loudness"]), ("lost", ["REJECTED"], ["phase"]), ("sync", ["PASSED"], []),
    ], "name string, expect_status array<string>, expect_event array<string>")
    results = spark.createDataFrame(
        [("ref", "PASSED"), ("black", "REJECTED"), ("loud", "REJECTED"), ("sync", "REJECTED")], "name string, status string")
    found = spark.createDataFrame(
        [("black", "black_frame_error"), ("loud", "true_peak"), ("sync", "avsync_error")], "name string, type string")
    graded = grade_cases(plan, results, found)
    assert {r.name: r.grade for r in graded.collect()} == {
        "ref": "PASS", "black": "PASS", "loud": "FAIL", "lost": "FAIL", "sync": "PASS"}
    assert system_accuracy(graded).first().accuracy_pct == 60.0


def test_avsync_and_interlace_rules(spark):
    offsets = spark.createDataFrame([(1, 50.0, 0.0, -50.0), (2, 10.0, 30.0, 20.0), (3, 5.0, 5.0, 0.0)],
                                    "file_id int, offset_head_ms double, offset_tail_ms double, drift_ms double")
    assert [r.status for r in video.avsync_status(offsets).orderBy("file_id").collect()] == ["REJECTED", "WARNING", "PASSED"]
    assert [r.status for r in video.avsync_status(offsets, "ott").orderBy("file_id").collect()] == ["WARNING", "WARNING", "PASSED"]


def test_loudness_sentinel(spark):
    rows = [("a", "strict", -99.0, 5.0), ("b", "strict", -23.5, -2.0), ("c", "youtube", -23.5, -2.0), ("d", "strict", -23.0, -0.5)]
    checked = sound.loudness_check(
        spark.createDataFrame(rows, "file_id string, profile string, integrated_lufs double, true_peak double"), profiles.profiles_table(spark))
    assert {r.file_id: (r.status, r.effective_status) for r in checked.collect()} == {
        "a": ("WARNING", "PASSED"), "b": ("PASSED", "PASSED"), "c": ("REJECTED", "REJECTED"), "d": ("REJECTED", "REJECTED")}


@pytest.fixture(scope="module")
def tables(spark):
    """One damaged and one clean file, as the measuring tools would report them."""
    frames = []
    for f, bad in (("bad", True), ("good", False)):
        for i in range(100):
            hot = bad and 20 <= i < 60
            frames.append((f, i, i * 40000 + (500000 if bad and i >= 80 else 0), 0 if hot else 16, 255 if hot else 235, 0, 9.0 if hot else 0.0))
    pixels = [(f, i, 8, [(r * 8 + c) * 3 % 200 + (0 if f == "bad" and 30 <= i < 50 else (i * 13 + c * 7) % 50) for r in range(8) for c in range(8)])
              for f in ("bad", "good") for i in range(100)]
    bad_log = ["[silencedetect] silence_end: 15.0 | silence_duration: 2.5", "x y z black_start:5 black_end:8 black_duration:3",
               "lavfi.freezedetect.freeze_start: 2.0", "lavfi.freezedetect.freeze_end: 4.25", "corrupt decoded frame in stream 0"]
    logs = [("bad", i, x) for i, x in enumerate(bad_log)] + [("good", 0, "quiet")]
    probe = lambda f, d: (f, ("mov", "20.0", "1000"), [("video", "1920", "1080", d, "1:1", "16:9", None, "100", {"language": "eng"})], True, True)
    stream = ("codec_type string, width string, height string, duration string, sample_aspect_ratio string, "
              "display_aspect_ratio string, channels string, bit_rate string, tags map<string,string>")
    mk = spark.createDataFrame
    return {
        "frames": mk(frames, "file_id string, frame_idx long, pts_us long, ymin int, ymax int, satmax int, vrep double"),
        "pixels": mk(pixels, "file_id string, frame_idx long, width int, px array<int>"),
        "logs": mk(logs, "file_id string, line_no long, line string"),
        "mono_logs": mk([("bad", 0, "[silencedetect] silence_end: 40.0 | silence_duration: 1.0")], "file_id string, line_no long, line string"),
        "channels": mk([("bad", 2), ("good", 2)], "file_id string, channels int"),
        "durations": mk([("bad", 20.0), ("good", 20.0)], "file_id string, duration_sec double"),
        "probes": mk([probe("bad", "18.0"), probe("good", "20.0")],
                     f"file_id string, format struct<format_name string, duration string, bit_rate string>, "
                     f"streams array<struct<{stream}>>, header_ok boolean, intact boolean"),
        "geometry": mk([("bad", 1920, 1080, "1:1", "4:3", 960, 540), ("good", 1920, 1080, "1:1", "16:9", 1920, 1080)],
                       "file_id string, width int, height int, sar string, dar string, act_w int, act_h int"),
        "bitrates": mk([("bad", 1920, 1080, 1000), ("good", 1920, 1080, 4000000)], "file_id string, width int, height int, bit_rate long"),
        "scores": mk([(f, float(i), i, 90.0 if f == "bad" and i > 5 else 10.0) for f in ("bad", "good") for i in range(10)],
                     "file_id string, ts double, ord long, score double"),
        "loudness": mk([("bad", -10.0, 0.0), ("good", -23.0, -2.0)], "file_id string, integrated_lufs double, true_peak double"),
        "audio_frames": mk([(f, i, -0.9 if f == "bad" else 0.9) for f in ("bad", "good") for i in range(20)], "file_id string, idx long, phase double"),
        "series": mk([(f, i, 1.0 if i % 17 == 3 else 0.0, 1.0 if i % 17 == (8 if f == "bad" else 3) else 0.0) for f in ("bad", "good") for i in range(200)],
                     "file_id string, i long, a double, v double"),
    }


def test_all_twelve_checks_end_to_end(spark, tables):
    dim = profiles.profiles_table(spark)
    out = C.run_checks(C.with_profiles(dim), tables, "strict")
    verdicts = {(r.file_id, r.module): r.effective_status for r in out.verdicts.collect()}
    assert len(verdicts) == 24
    wrong = {m for (f, m), s in verdicts.items() if f == "good" and s not in ("PASSED",)}
    assert wrong <= {"validate_interlace"}
    kinds = {}
    for r in out.events.collect():
        kinds.setdefault((r.file_id, r.module), set()).add(r.type)
    assert not any(f == "good" and m != "validate_interlace" for f, m in kinds)
    bad = lambda m: (verdicts["bad", m], kinds.get(("bad", m), set()))
    assert bad("validate_structure") == ("WARNING", {"metadata_mismatch"})
    assert bad("validate_frames") == ("REJECTED", {"corrupt_packet", "frame_gap", "freeze_frame", "timestamp_drift"})
    assert bad("validate_analog")[0] == "WARNING"
    assert bad("validate_black_freeze") == ("REJECTED", {"black_frame_error", "video_freeze"})
    assert bad("validate_artifacts") == ("REJECTED", {"bitrate_starvation", "compression_artifact_ml"})
    assert bad("validate_geometry") == ("REJECTED", {"ar_distortion", "letterbox_detected", "pillarbox_detected", "small_active_area"})
    assert bad("validate_signal") == ("REJECTED", {"broadcast_illegal_burst"})
    assert bad("validate_loudness") == ("REJECTED", {"loudness_violation", "true_peak_violation"})
    assert bad("validate_audio_signal") == ("REJECTED", {"audio_dropout", "phase_inversion_detected"})
    assert bad("validate_phase")[0] == "REJECTED"
    assert bad("validate_avsync") == ("REJECTED", {"av_sync_error"})

    reports = out.verdicts.withColumn("profile", F.lit("strict"))
    events = out.events.withColumn("ord", F.monotonically_increasing_id())
    master = master_report(reports, events, dim)
    files = {r.file_id: r for r in master.files.collect()}
    assert files["bad"].overall_status == "REJECTED"
    assert files["bad"].n_modules == 12
    assert files["bad"].config_version_hash == profiles.config_hash("strict")
    assert files["good"].overall_status in ("PASSED", "WARNING")


def test_failing_validator_becomes_a_row(spark, tables):
    from framewarden.operators.folding import Validator, map_segments

    def broken(state, batch):
        raise RuntimeError("boom")

    count = Validator(lambda: 0, lambda n, batch: n + len(batch), lambda a, b: a + b, lambda n: "PASSED" if n else "WARNING")
    rows = tables["frames"].withColumn("segment_id", (F.col("frame_idx") / 50).cast("int"))
    got = {(r.file_id, r.segment_id, r.module): (r.status, r.error)
           for r in map_segments(rows, {"fine": count, "broken": Validator(count.init, broken, count.merge, count.finish)}).collect()}
    assert len(got) == 8
    assert got["bad", 1, "broken"] == ("CRASHED", "boom")
    assert got["good", 0, "fine"] == ("PASSED", None)


def test_events_of_unlisted_segments_stay(spark):
    from framewarden.operators.segments import join_segment_offset

    events = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (1, None, 4.0), (2, 0, 5.0)], "file_id long, segment_id int, start_time double")
    segments = spark.createDataFrame([(1, 0, 0.0), (1, 1, 60.0)], "file_id long, segment_id int, start_time double")
    got = sorted((r.start_time, r.segment_start, r.listed) for r in join_segment_offset(events, segments).collect())
    assert got == [(2.0, 0.0, True), (3.0, 60.0, True), (4.0, 0.0, False), (5.0, 0.0, False)]


def test_every_log_error_counts(spark):
    from framewarden.plans import checks

    logs = spark.createDataFrame([(1, i, "corrupt decoded frame " + "x" * 200) for i in range(25)], "file_id long, line_no long, line string")
    frames = spark.createDataFrame([(1, 0, 0)], "file_id long, frame_idx long, pts_us long")
    pixels = spark.createDataFrame([(2, 0, [1, 2])], "file_id long, frame_idx long, px array<int>")
    files, events = checks.frames_report({"logs": logs, "frames": frames, "pixels": pixels})
    assert events.count() == 25 and events.first().details.endswith("x" * 200)
    assert sorted((r.file_id, r.status) for r in files.collect()) == [(1, "REJECTED"), (2, "PASSED")]


def test_report_order_has_room(spark):
    from framewarden.plans.master import report_events

    event = "struct<type:string,start_time:double,end_time:double,timestamp:double,severity:string,details:string,confidence:double,source_module:string>"
    rows = [(1, "m", 2**62 + i, [], [("t", 1.0, 2.0, None, None, None, None, None)] * 2) for i in range(3)]
    reports = spark.createDataFrame(rows, f"file_id long, module string, report_ord long, details_events array<{event}>, events array<{event}>")
    reports = reports.withColumn("segment_offset_sec", F.lit(0.0))
    assert len({r.ord for r in report_events(reports).collect()}) == 6


def test_a_custom_profile_decides(spark):
    table = profiles.profiles_table(spark)
    house = table.where("profile = 'ott'").withColumn("profile", F.lit("house")).withColumn("threshold_score", F.lit(12.5))
    asked = spark.createDataFrame([(1, "house"), (2, "unknown")], "file_id long, profile string")
    joined = profiles.join_profile(asked, table.union(house))
    got = {r.file_id: r.resolved_profile for r in joined.collect()}
    assert got == {1: "house", 2: "strict"}
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert profiles.with_profile(asked, table.union(house), "house").first().threshold_score == 12.5


def test_heat_map_takes_any_score(spark):
    from framewarden.operators.intervals import severity_heatmap

    events = spark.createDataFrame([(1, 0.0, 2.5, 4), (1, 1.0, 1.5, 9), (1, 4.0, 5.0, 0)], "file_id long, start_time double, end_time double, severity_score int")
    assert [r.level for r in severity_heatmap(events, bins_per_chunk=2).orderBy("bin").collect()] == [4, 9, 4, 0, 1, 1]


def test_gaps_across_holes_do_not_depend_on_chunks(spark):
    from framewarden.operators.frames import frame_gaps

    frames = spark.createDataFrame([(1, i, i * 40_000) for i in range(20) if i not in (3, 4, 7, 8, 9, 10, 11)], "file_id long, frame_idx long, pts_us long")
    found = [sorted(r.frame_idx for r in frame_gaps(frames, 25.0, chunk_rows=n).collect()) for n in (2, 4, 1000)]
    assert found == [[5, 12]] * 3


def test_few_defects_say_how_many_more(spark):
    from framewarden.operators.events import top_defects

    events = spark.createDataFrame([(1, t) for t in "dcba"], "file_id long, type string")
    assert top_defects(events).first().defects == "a, b, c, d"
    assert top_defects(events, 3).first().defects == "a, b, c (+1 more)"


def test_sync_is_scaled_within_its_window(spark):
    from framewarden.plans.checks import avsync_report

    steps = [(1, i, float(i == 3), float(i == 5)) for i in range(40)]
    loud = [(1, i, a + 1000.0 * (i == 20), v + 1000.0 * (i == 20)) for _, i, a, v in steps]
    durations = spark.createDataFrame([], "file_id long, duration_sec double")
    for rows in (steps, loud):
        series = spark.createDataFrame(rows, "file_id long, i long, a double, v double")
        files, _ = avsync_report(series, durations, window=10)
        row = files.first()
        assert row.confidence_score == 1.0 and row.offset_head_ms == 46.44


def test_severity_of_the_score_as_measured(spark, tmp_path):
    """A score just below a limit stays below it, though its two decimals reach it."""
    import __spark_entry__ as contract

    at = datetime.datetime(2024, 1, 1)
    # (end - start) * 20 of 1.75 seconds: 35 at a start of 0 s, 34.99999999999986 at 62.252 s.
    events = [(0, at, 0, "click", 35.0, '{"k": 1}'), (1, at + datetime.timedelta(microseconds=62_252 * 3_600_000), 1, "click", 35.0, '{"k": 1}')]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    from framewarden.fixtures import load

    raw = {r.file_id: r.score for r in load(spark, str(tmp_path), "frame_scores").collect()}
    assert raw[0] == 35.0 and 34.99 < raw[1] < 35.0
    scores = load(spark, str(tmp_path), "frame_scores")
    again = scores.withColumns({"ord": F.col("ord") + 10, "ts": F.col("ts") + 1.25})
    from framewarden.catalog import composites

    got = [r.file_id for r in composites.ml_timeline(scores.union(again)).collect()]
    assert got == [0]
    assert "ml_timeline" in contract.queries()

    rows = scores.union(again).withColumn("score", F.when(F.col("file_id") == 0, 40.0).otherwise(39.999))
    bitrates = spark.createDataFrame([(0, 1920, 1080, 4000000), (1, 1920, 1080, 4000000)], "file_id long, width int, height int, bit_rate long")
    _, found = C.artifacts_report({"bitrates": bitrates, "scores": rows}, profiles.profiles_table(spark), "ott")
    assert [r.file_id for r in found.collect()] == [0]


def test_all_checks_meet_the_files_in_one_shuffle(spark, tables):
    """Every file has a verdict of every module, of one grouping instead of a join a module."""
    listed = spark.createDataFrame([("bad",), ("good",), ("new",)], "file_id string")
    out = C.run_checks(C.with_profiles(profiles.profiles_table(spark)), {**tables, "files": listed}, "strict").verdicts
    plain = C.run_checks(C.with_profiles(profiles.profiles_table(spark)), tables, "strict").verdicts
    got = {tuple(r) for r in out.select("file_id", "module", "status", "effective_status", "ord").collect()}
    want = {tuple(r) for r in plain.select("file_id", "module", "status", "effective_status", "ord").collect()}
    assert {r for r in got if r[0] != "new"} == want
    fresh = {m: "PASSED" if m == "validate_frames" else "WARNING" for m in C.MODULES}
    assert {r for r in got if r[0] == "new"} == {("new", m, s, s, k) for k, (m, s) in enumerate(fresh.items())}
    one = C.run_checks({"only": lambda t, mode: C.Outcome(spark.createDataFrame([("bad", "only", "REJECTED", None), ("else", "only", "PASSED", "PASSED")], "file_id string, module string, status string, effective_status string"), None, None)}, {"files": listed}, modules=("only",)).verdicts
    assert "Join" not in one._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, one.select("file_id", "status", "effective_status").collect())) == [
        ("bad", "REJECTED", "WARNING"), ("good", "WARNING", "WARNING"), ("new", "WARNING", "WARNING")]

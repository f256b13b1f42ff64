"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from framewarden.operators.intervals import stitch_events
from framewarden.plans.master import report_events
from framewarden.sources import readers, writers


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.MP4", "sub/b.mxf", "sub/c.txt", "d.ts", "noext"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda **k: sorted(r.filename for r in readers.scan_media_manifest(spark, str(tmp_path), **k).collect())
    assert names() == ["a.MP4", "b.mxf"]
    assert names(suffixes=readers.BATCH_SUFFIXES) == ["a.MP4", "b.mxf", "d.ts"]


def test_reports_with_bad_and_partial_documents(spark, tmp_path):
    folder = tmp_path / "clip_qc_report"
    folder.mkdir()
    docs = {
        "report_structure": {"module": "validate_structure", "status": "PASSED", "metrics": {"duration_sec": 3.5},
                             "events": [{"type": "metadata_mismatch"}], "effective_status": "WARNING"},
        "report_black": {"status": "REJECTED", "details": {"events": [
            {"type": "black_frame", "start_time": 2.0, "end_time": 5.0, "details": "dark"}], "mean": 1.5}},
    }
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=4))
    (folder / "report_broken.json").write_text('{"module": "x", ')
    got = {r.module: r for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert set(got) == {"validate_structure", "report_black"}
    assert got["report_black"].file_id == "clip_qc_report"
    assert got["report_black"].details["mean"] == "1.5"
    assert got["report_black"].details_events[0].start_time == 2.0
    assert got["validate_structure"].metrics == {"duration_sec": "3.5"}

    reports = readers.read_reports(spark, str(tmp_path)).withColumn("report_ord", F.when(F.col("module") == "report_black", 1).otherwise(0))
    raw = report_events(reports)
    assert sorted((r.source_module, r.type, r.start_time) for r in raw.collect()) == [
        ("report_black", "black_frame", 2.0), ("validate_structure", "metadata_mismatch", None)]
    timed = {r.type: (r.start_time, r.end_time) for r in stitch_events(report_events(reports, normalize=True)).collect()}
    assert timed == {"black_frame": (2.0, 5.0), "metadata_mismatch": (0.0, 1.0)}


def test_probes_frames_and_logs(spark, tmp_path):
    for d in ("probes", "frames", "logs"):
        (tmp_path / d).mkdir()
    probe = {"format": {"format_name": "mov", "duration": "12.5"}, "streams": [
        {"codec_type": "video", "width": 1920, "height": 1080, "tags": {"language": "und"}}, {"codec_type": "audio"}]}
    (tmp_path / "probes/a.json").write_text(json.dumps(probe, indent=1))
    (tmp_path / "probes/b.json").write_text("{}")
    probes = {r.file_id: r for r in readers.read_probes(spark, str(tmp_path / "probes")).collect()}
    assert probes["a"].header_ok and not probes["b"].header_ok
    assert (probes["a"].streams[0].width, len(probes["a"].streams)) == ("1920", 2)

    frames = {"frames": [
        {"pkt_pts_time": "0.04", "tags": {"YMIN": "3", "lavfi.signalstats.VREP": "7.5"}},
        {"tags": {"YMIN": "n/a"}}, {"pkt_pts_time": "0.08", "tags": {"YMAX": "240", "SATMAX": "111"}}]}
    (tmp_path / "frames/a.json").write_text(json.dumps(frames))
    rows = sorted((tuple(r) for r in readers.read_frame_stats(spark, str(tmp_path / "frames")).collect()), key=lambda r: r[1])
    assert rows == [("a", 0, 40000, 3, 235, 0, 7.5), ("a", 1, 0, None, 235, 0, 0.0), ("a", 2, 80000, 16, 240, 111, 0.0)]

    (tmp_path / "logs/a.log").write_text("first\n\nthird")
    logs = sorted(tuple(r) for r in readers.read_logs(spark, str(tmp_path / "logs")).collect())
    assert logs == [("a", "logs", 0, "first"), ("a", "logs", 1, ""), ("a", "logs", 2, "third")]


def test_segment_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text("seg_000.mp4,0.000000,300.1\n\nseg_001.mp4,300.1,410.0\n")
    got = sorted(tuple(r) for r in readers.read_segment_list(spark, str(tmp_path / "list.csv")).collect())
    assert got == [("seg_000.mp4", 0.0), ("seg_001.mp4", 300.1)]


def test_master_documents_have_one_layout(spark, tmp_path):
    files = spark.createDataFrame([(1, "PASSED", "x")], "file_id long, overall_status string, profile string")
    modules = spark.createDataFrame([(1, "a", "PASSED", {"m": 1.5})], "file_id long, module string, status string, metrics map<string,double>")
    events = spark.createDataFrame(
        [(1, "t", float(i) * 3600, float(i) * 3600 + 1, "MILD", "d") for i in range(20)],
        "file_id long, type string, start_time double, end_time double, severity string, details string",
    )
    writers.write_master(files, modules, events, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/files")).count() == 1
    assert spark.read.json(str(tmp_path / "m/modules")).first().metrics.m == 1.5
    assert spark.read.json(str(tmp_path / "m/events")).count() == 20


def test_jdbc_needs_bounds(spark):
    with pytest.raises(ValueError, match="partitionColumn"):
        readers.read_jobs(spark, url="jdbc:x", dbtable="jobs")


def test_executive_summary_lists_failures_first(spark, tmp_path):
    rows = [("b.mp4", "PASSED", "", 3.0), ("c.mp4", "REJECTED", "black", 1.0), ("a.mp4", "PASSED", "", 2.0)]
    summary = spark.createDataFrame(rows, "filename string, status string, defects string, duration double")
    writers.write_executive_summary(summary, str(tmp_path / "s"))
    lines = [x for f in sorted((tmp_path / "s").glob("part-*.csv")) for x in f.read_text().splitlines()]
    body = [x for x in lines if not x.startswith("Filename")]
    assert [x.split(",")[0] for x in body] == ["c.mp4", "a.mp4", "b.mp4"]


def test_commits_are_per_file_and_lost_runs_unseen(spark, tmp_path):
    import json

    from framewarden.sources import master_store as store

    path = str(tmp_path / "store")
    schemas = {"files": "file_id long, overall_status string", "modules": "file_id long, module string, status string, n int", "events": "file_id long, start_time double, type string"}
    frame = lambda name, rows: spark.createDataFrame(rows, schemas[name])

    def commit(ids, status):
        store.commit_master(
            frame("files", [(i, status) for i in ids]), frame("modules", [(i, m, status, i) for i in ids for m in "ab"]),
            frame("events", [(i, t, status) for i in ids for t in (3.0, 1.0)]), path)

    commit(range(10), "PASSED")
    commit([2, 3], "WARNING")
    commit([3, 11], "REJECTED")
    want = {i: "PASSED" for i in range(10)} | {2: "WARNING", 3: "REJECTED", 11: "REJECTED"}

    def check():
        tables = store.read_master(spark, path, schemas)
        assert {r.file_id: r.overall_status for r in tables["files"].collect()} == want
        assert sorted((r.file_id, r.module, r.status) for r in tables["modules"].collect()) == sorted((i, m, s) for i, s in want.items() for m in "ab")
        assert sorted((r.file_id, r.start_time, r.type) for r in tables["events"].collect()) == sorted((i, t, s) for i, s in want.items() for t in (1.0, 3.0))
        return tables

    check()
    # Runs lost after one, two and three of the tables.
    for n in (1, 2, 3):
        for name in list(schemas)[:n]:
            rows = {"files": [(2, "LOST")], "modules": [(2, "a", "LOST", 0)], "events": [(2, 9.0, "LOST")]}[name]
            frame(name, rows).write.json(f"{path}/{name}/run=9999999999999999999{n}-lost")
        tables = check()
    got = json.loads(store.master_document(tables, 3).first().document)
    assert got == {
        "file_id": 3, "overall_status": "REJECTED", "modules": {m: {"status": "REJECTED", "n": 3} for m in "ab"},
        "aggregated_events": [{"start_time": t, "type": "REJECTED"} for t in (1.0, 3.0)],
    }
    assert store.manifest(spark, path).count() == 11


def test_work_list_and_ghosts(spark):
    from framewarden.operators import ledger

    expected = spark.createDataFrame([(1, m, "c") for m in "abcde"] + [(2, "a", "c")] * 2, "file_id long, module string, config_hash string")
    rows = [(1, "a", "c", 1, "PASSED"), (1, "b", "c", 1, "CRASHED"), (1, "b", "c", 2, None), (1, "c", "c", 1, None), (1, "c", "c", 2, None), (1, "c", "c", 3, "CRASHED"),
            (1, "d", "old", 1, "PASSED"), (1, "e", "c", 1, "CRASHED"), (1, "e", "c", 2, "REJECTED"), (9, "a", "c", 1, "PASSED")]
    states = ledger.work_states(expected, spark.createDataFrame(rows, "file_id long, module string, config_hash string, attempt int, status string"))
    assert {(r.file_id, r.module): r.state for r in states.collect()} == {
        (1, "a"): "DONE", (1, "b"): "REPEAT", (1, "c"): "CRASHED", (1, "d"): "RUN", (1, "e"): "DONE", (2, "a"): "RUN"}
    assert sorted((r.file_id, r.module, r.attempt) for r in ledger.work_list(states).collect()) == [(1, "b", 3), (1, "d", 1), (2, "a", 1)]
    assert [(r.module, r.status) for r in ledger.ghost_reports(states).collect()] == [("c", "CRASHED")]

"""Quality-control inputs derived from the general test tables.

Each view is a projection written once in the SQL both engines share; four
spellings differ and are filled in per engine.  ``frames`` and ``pixels`` number
their rows per file, which Spark does chunk by chunk (``operators.chunks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.chunks import index_chunk, numbered, time_chunk

SPARK = {
    "$US": "(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp '2024-01-01 00:00:00'))",
    "$DIV": "div",
    "$PX": "transform(embedding, x -> greatest(0, least(255, cast(floor(128 + 4 * cast(x as double)) as int))))",
    "$HOT": "transform(embedding, x -> greatest(0, least(255, cast(floor(128 + 400 * cast(x as double)) as int))))",
}
DUCK = {
    "$US": "(epoch_us(ts) - epoch_us(timestamp '2024-01-01'))",
    "$DIV": "//",
    "$PX": "list_transform(embedding, lambda x: greatest(0, least(255, cast(floor(128 + 4 * cast(x as double)) as int))))",
    "$HOT": "list_transform(embedding, lambda x: greatest(0, least(255, cast(floor(128 + 400 * cast(x as double)) as int))))",
}

_SEC = "printf('%d.%02d', {0} $DIV 100, {0} % 100)"


def _sec(cents: str) -> str:
    return _SEC.format(cents)


_AT = "((us $DIV 36000000))"  # hundredths of a media second

# name -> (source, {column: expression}, filter or None)
VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "qc_base": (
        "events",
        {
            "event_id": "event_id",
            "file_id": "user_id % 5",
            "user_id": "user_id",
            "event_type": "event_type",
            "value": "value",
            "cents": "cast(round(value * 100) as bigint)",
            "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)",
            "us": "$US",
        },
        None,
    ),
    "timeline": (
        "qc_base",
        {
            "file_id": "file_id",
            "ord": "event_id",
            "type": "event_type",
            "start_time": "(us $DIV 3600000) / 1000.0e0",
            "end_time": "((us $DIV 3600000) + cast(floor(value * 50) as bigint)) / 1000.0e0",
            "severity": "case when k >= 80 then 'CRITICAL' when k >= 50 then 'WARNING' else 'MILD' end",
            "details": "concat('k', cast(k % 3 as string))",
            "module": "concat('m', cast(k % 4 as string))",
            "k": "k",
        },
        None,
    ),
    # Event words as the checks write them, for categories and summaries.
    "worded": (
        "timeline",
        {
            "file_id": "file_id",
            "ord": "ord",
            "type": "case type when 'click' then 'black_frame_error' when 'view' then 'audio_silence' "
            "when 'error' then 'peak2x_drift' when 'signup' then 'bitrate_starvation' else 'broadcast_illegal_burst' end",
            "module": "case k % 4 when 0 then 'validate_loudness' when 1 then 'validate_avsync' "
            "when 2 then 'validate_structure' else 'validate_frames' end",
            "start_time": "case when k % 10 <> 0 then start_time end",
            "timestamp": "case when k % 20 <> 0 then start_time end",
            "end_time": "case when k % 7 <> 0 then end_time end",
            "severity": "case k % 6 when 0 then 'CRITICAL' when 1 then 'WARNING' when 2 then 'moderate' "
            "when 3 then 'PASSED' when 4 then 'odd' end",
            "details": "case when k % 5 = 0 then 'Block noise' when k % 5 < 4 then details end",
        },
        None,
    ),
    "frame_scores": (
        "timeline",
        {
            "file_id": "file_id",
            "ord": "ord",
            "ts": "start_time",
            "score": "least((end_time - start_time) * 20, 100.0e0)",
        },
        None,
    ),
    "reports": (
        "orders",
        {
            "report_id": "o_orderkey",
            "file_id": "o_custkey % 50",
            "ord": "o_orderkey % 12",
            "module": "concat('validate_', cast(o_orderkey % 12 as string))",
            "status": "case o_orderstatus when 'F' then 'REJECTED' when 'P' then 'WARNING' else 'PASSED' end",
        },
        None,
    ),
    # Reports of many small files with every status word, a few without status.
    "mixed_reports": (
        "orders",
        {
            "file_id": "o_custkey",
            "ord": "o_orderkey",
            "module": "concat('validate_', cast(o_orderkey % 6 as string))",
            "status": "case o_orderkey % 9 when 0 then 'CRASHED' when 1 then 'CORRUPT' when 2 then 'WARNING' "
            "when 3 then 'ERROR' when 4 then 'SKIPPED' when 5 then 'REJECTED' when 6 then 'PASS' "
            "when 7 then 'PASSED' end",
            "effective_status": "case when o_orderkey % 4 = 0 then 'PASSED' when o_orderkey % 11 = 0 then 'WARNING' end",
            "profile": "case o_custkey % 5 when 0 then 'strict' when 1 then 'netflix_hd' when 2 then 'youtube' "
            "when 3 then 'ott' else 'archive' end",
            "mode": "case when o_custkey % 2 = 0 then 'strict' else 'youtube' end",
            "n_events": "o_orderkey % 3",
            "has_video_file": "o_orderkey % 5 <> 0",
            "has_metrics": "o_orderkey % 7 <> 0",
        },
        None,
    ),
    "segment_reports": (
        "lineitem",
        {
            "file_id": "l_orderkey % 100",
            "segment_id": "l_linenumber",
            "module": "concat('m', cast(l_partkey % 4 as string))",
            "status": "case l_returnflag when 'R' then 'REJECTED' when 'A' then 'WARNING' else 'PASSED' end",
            "v": "l_quantity",
            "start_time": "(l_linenumber - 1) * 60",
        },
        None,
    ),
    # The same timeline cut into six-second segments with relative times.
    "segment_events": (
        "qc_base",
        {
            "file_id": "file_id",
            "segment_id": "cast((us $DIV 3600000) $DIV 6000 as int)",
            "segment_start": "((us $DIV 3600000) $DIV 6000) * 6.0e0",
            "ord": "event_id",
            "module": "concat('m', cast(k % 4 as string))",
            "type": "event_type",
            "start_time": "((us $DIV 3600000) % 6000) / 1000.0e0",
            "end_time": "((us $DIV 3600000) % 6000 + cast(floor(value * 50) as bigint)) / 1000.0e0",
            "severity": "case when k >= 80 then 'CRITICAL' when k >= 50 then 'WARNING' else 'MILD' end",
            "details": "concat('k', cast(k % 3 as string))",
            "status": "case when k >= 95 then 'REJECTED' when k >= 60 then 'WARNING' when k = 7 then 'CRASHED' else 'PASSED' end",
        },
        None,
    ),
    "jobs": (
        "orders",
        {
            "id": "o_orderkey",
            "original_filename": "concat('file_', cast(o_custkey as string), '.mp4')",
            "status": "case o_orderstatus when 'F' then 'FAILED' when 'P' then 'QUEUED' else 'COMPLETED' end",
            "created_at": "o_orderdate",
            "fix_status": "case when o_orderkey % 7 = 0 then 'QUEUED' end",
            "result_path": "case when o_orderkey % 3 <> 0 then concat('out/', cast(o_orderkey as string), '.json') end",
        },
        None,
    ),
    "report_paths": (
        "orders",
        {
            "path": "concat('out/', cast(o_orderkey as string), '.json')",
            "overall_status": "case o_orderstatus when 'F' then 'REJECTED' else 'PASSED' end",
        },
        "o_orderkey % 5 <> 0",
    ),
    "silences": (
        "timeline",
        {"file_id": "file_id", "ord": "ord", "type": "type", "start": "start_time", "end": "end_time"},
        "type in ('error', 'view')",
    ),
    "freeze_tokens": (
        "timeline",
        {
            "file_id": "file_id",
            "line_no": "ord",
            "kind": "case type when 'click' then 'start' else 'end' end",
            "at": "start_time",
        },
        "type in ('click', 'signup')",
    ),
    "audio_frames": (
        "qc_base",
        {"file_id": "user_id", "idx": "event_id", "phase": "((cents * 7) % 2000 - 800) / 1000.0e0"},
        None,
    ),
    "probes_flat": (
        "orders",
        {
            "file_id": "o_orderkey",
            "mode": "case when o_custkey % 2 = 0 then 'strict' else 'youtube' end",
            "header_ok": "o_orderkey % 97 <> 0",
            "intact": "o_orderkey % 13 <> 0",
            "container": "case o_orderkey % 3 when 0 then 'mov,mp4' when 1 then 'matroska' else 'mxf' end",
            "dur_tenths": "o_custkey % 90000",
            "bit_rate": "cast(floor(o_totalprice) as bigint)",
            "has_video": "o_orderkey % 10 <> 0",
            "stream_tenths": "case when o_orderkey % 8 = 0 then 0 else o_custkey % 90000 + o_orderkey % 11 end",
            "width": "case o_orderkey % 4 when 0 then 1920 when 1 then 1280 when 2 then 720 else 3840 end",
            "height": "case o_orderkey % 4 when 0 then 1080 when 1 then 720 when 2 then 486 else 2160 end",
            "sar": "case o_orderkey % 7 when 0 then '8:9' when 1 then '0:1' when 2 then '10:11' when 3 then 'N/A' else '1:1' end",
            "dar": "case o_orderkey % 6 when 0 then '4:3' when 1 then '0:0' when 2 then '1.7778' else '16:9' end",
            "v_lang": "case o_orderkey % 5 when 0 then 'und' when 1 then 'eng' when 2 then 'deu' when 3 then 'fra' end",
            "n_audio": "o_orderkey % 4",
            "a_lang": "case o_custkey % 4 when 0 then 'eng' when 1 then 'und' when 2 then 'spa' end",
            "n_subs": "o_custkey % 3",
        },
        None,
    ),
    # Active picture area seen per file; null = none detected.
    "crops": (
        "orders",
        {
            "file_id": "o_orderkey",
            "mode": "case when o_custkey % 2 = 0 then 'strict' else 'youtube' end",
            "width": "1920",
            "height": "1080",
            "act_w": "case when o_orderkey % 12 <> 0 then 1920 - cast(o_custkey % 9 as int) * 60 end",
            "act_h": "case when o_orderkey % 12 <> 0 then 1080 - cast(o_orderkey % 7 as int) * 40 end",
        },
        None,
    ),
    "loudness": (
        "orders",
        {
            "file_id": "o_orderkey",
            "profile": "case o_custkey % 5 when 0 then 'strict' when 1 then 'netflix_hd' when 2 then 'youtube' "
            "when 3 then 'ott' else 'archive' end",
            "integrated_lufs": "case when o_orderkey % 50 = 0 then -99.0e0 else -10.0e0 - (o_orderkey % 37) / 2.0e0 end",
            "true_peak": "((o_custkey % 9) - 6) / 2.0e0",
        },
        None,
    ),
    "bitrates": (
        "orders",
        {
            "file_id": "o_orderkey",
            "width": "case o_orderkey % 4 when 0 then 1920 when 1 then 1280 when 2 then 0 else 3840 end",
            "height": "case o_orderkey % 4 when 0 then 1080 when 1 then 720 when 2 then 486 else 2160 end",
            "bit_rate": "cast(floor(o_totalprice / 3) as bigint)",
        },
        None,
    ),
    "named_scores": (
        "part",
        {
            "frame_name": "concat(case p_partkey % 5 when 0 then 'clip_HIGH_' when 1 then 'medium_' when 2 then 'x_Low_' "
            "when 3 then 'high_low_' else 'plain_' end, p_type, '.jpg')",
            "score": "p_size * 1.5e0 + (p_partkey % 5) * 8",
        },
        None,
    ),
    "batch_results": (
        "orders",
        {
            "file_id": "o_orderkey",
            "filename": "concat('file_', cast(o_orderkey as string), '.mp4')",
            "status": "case o_orderkey % 5 when 0 then 'SYSTEM_FAIL' when 1 then 'REJECTED' when 2 then 'WARNING' else 'PASSED' end",
            "duration": "cast(o_custkey % 500 as bigint)",
            "outcome": "case when o_orderkey % 5 = 0 then 'FAILED' else 'SUCCESS' end",
        },
        None,
    ),
    "test_plan": (
        "customer",
        {
            "name": "c_custkey",
            "clean": "c_custkey % 4 = 0",
            "want_rejected": "c_custkey % 3 = 0",
            "keyword": "case c_nationkey % 5 when 0 then 'iew' when 1 then 'err' when 2 then 'click' when 3 then 'sign' else 'avsync' end",
        },
        None,
    ),
    # Event types a graded run found; some purchases stand for a sync finding.
    "found_types": (
        "qc_base",
        {
            "name": "user_id",
            "ord": "event_id",
            "type": "case when event_type = 'purchase' and k % 2 = 0 then 'avsync_error' else event_type end",
            "k": "k",
        },
        None,
    ),
    "docs_flat": (
        "qc_base",
        {
            "file_id": "file_id",
            "report_ord": "event_id",
            "module": "concat('m', cast(k % 4 as string))",
            "segment_offset_sec": "(k % 2) * 60.0e0",
            "n_top": "case when k % 3 = 1 then 0 else 1 end",
            "n_nested": "case when k % 3 = 0 then 0 else 1 end",
            "type": "event_type",
            "start_time": "case when k % 11 <> 0 then (us $DIV 3600000) / 1000.0e0 end",
            "end_time": "((us $DIV 3600000) + cast(floor(value * 50) as bigint)) / 1000.0e0",
        },
        None,
    ),
    "logs": (
        "qc_base",
        {
            "file_id": "file_id",
            "line_no": "event_id",
            "job_id": "user_id",
            "line": "case event_id % 14 "
            "when 0 then case when k % 10 = 0 then '[silencedetect] silence_end: n/a | silence_duration: 1.0' "
            f"else concat('[silencedetect] silence_end: ', {_sec(_AT)}, ' | silence_duration: ', {_sec('(cents % 900)')}) end "
            f"when 1 then concat('[blackdetect @ 0x1] black_start:', {_sec('(cents % 70000)')}, "
            f"' black_end:', {_sec('(cents % 70000 + k * 10)')}, ' black_duration:', {_sec('(k * 10)')}) "
            f"when 2 then concat('[freezedetect @ 0x2] lavfi.freezedetect.freeze_start: ', {_sec(_AT)}) "
            f"when 3 then concat('[freezedetect @ 0x2] lavfi.freezedetect.freeze_end: ', {_sec(_AT)}) "
            f"when 4 then concat('    I:         -', {_sec('(cents % 4000)')}, ' LUFS') "
            f"when 5 then concat('    LRA:         ', {_sec('(cents % 2000)')}, ' LU') "
            f"when 6 then concat('  True peak:  -', {_sec('(cents % 900)')}, ' x -', {_sec('(cents % 700)')}, ' dBTP') "
            "when 7 then concat('lavfi.astats.Overall.DC_offset=', case when k % 2 = 0 then '-' else '' end, printf('0.%06d', cents % 3000)) "
            f"when 8 then concat('lavfi.astats.Overall.Dynamic_range=', {_sec('(cents % 9000)')}) "
            f"when 9 then concat('[volumedetect] max_volume: -', {_sec('(cents % 3000)')}, ' dB') "
            "when 10 then concat('  frame=1 time=', printf('%02d:%02d:%02d.50', cents % 24, cents % 60, k % 60), "
            "case k % 3 when 0 then ' DTS 12 < 40 out of order' when 1 then ' pts 9 < 11 and dts 3 < 4' else ' fine' end) "
            "when 11 then case when k % 2 = 0 then concat('corrupt DECODED frame in stream ', cast(k as string)) "
            "else 'Timestamp Discontinuity seen' end "
            "when 12 then case when k % 4 = 0 then concat('[PROGRESS] ', cast(k as string)) "
            "else concat('[PROGRESS]  ', cast(k as string), ' - Step ', cast(k % 13 as string)) end "
            "else case when k % 3 = 0 then 'crop=none' else concat('crop=10:20:0:0 t:1 crop=', cast(1900 - k as string), ':', "
            "cast(1060 - k as string), ':', cast(k as string), ':8') end end",
        },
        None,
    ),
    "loudnorm_logs": (
        "qc_base",
        {
            "file_id": "event_id",
            "log": "case when k % 10 = 0 then 'no block here }' when k % 10 = 1 then concat('{ open ', cast(k as string)) "
            "else concat('head {\"x\": 1} text\n{\n\t\"input_i\" : \"-', cast(k as string), '.5\",\n\t\"input_tp\" : \"',"
            " case when k % 10 = 2 then 'bad' else '-1.50' end, '\",\n\t\"input_lra\" : \"7.0\",\n\t\"input_thresh\" : \"-33.0\"\n}\ntail ',"
            " cast(event_id as string)) end",
        },
        None,
    ),
    "pixels_raw": ("embeddings", {"label": "label", "vec_id": "vec_id", "px": "$PX"}, None),
    "textured_raw": ("embeddings", {"label": "label", "vec_id": "vec_id", "px": "$HOT"}, None),
    "frames_raw": (
        "qc_base",
        {
            "file_id": "file_id",
            "event_id": "event_id",
            "us": "us",
            "pts_us": "us $DIV 36000",
            "ymin": "greatest(0, 24 - cast(floor(value / 20) as int))",
            "ymax": "175 + k",
            "satmax": "cast(floor(value) as int)",
            "vrep": "value / 10.0e0",
        },
        None,
    ),
}

_FRAME_COLS = ("pts_us", "ymin", "ymax", "satmax", "vrep")

# Numbered views in DuckDB; Spark builds them with ``numbered``.
NUMBERED = {
    "frames": (
        "frames_raw",
        "select file_id, row_number() over (partition by file_id order by us, event_id) - 1 as frame_idx, "
        + ", ".join(_FRAME_COLS)
        + " from frames_raw",
    ),
    "pixels": (
        "pixels_raw",
        "select label as file_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, "
        "8 as width, px from pixels_raw",
    ),
    "textured": (
        "textured_raw",
        "select label as file_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, "
        "8 as width, px from textured_raw",
    ),
}

# Ten minutes of source time per numbering chunk.
_FRAME_CHUNK_US = 600_000_000


def _fill(text: str, words: dict[str, str]) -> str:
    for mark, word in words.items():
        text = text.replace(mark, word)
    return text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a view over one."""
    if name in NUMBERED:
        raw = load(spark, sf_dir, NUMBERED[name][0])
        if name == "frames":
            out = numbered(raw, ["file_id"], time_chunk("us", _FRAME_CHUNK_US), ["us", "event_id"])
            return out.select("file_id", "frame_idx", *_FRAME_COLS)
        out = numbered(raw.withColumnRenamed("label", "file_id"), ["file_id"], index_chunk("vec_id"), ["vec_id"])
        return out.select("file_id", "frame_idx", F.lit(8).alias("width"), "px")
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns, keep = VIEWS[name]
    df = load(spark, sf_dir, source)
    if keep:
        df = df.where(_fill(keep, SPARK))
    # Long log texts are built once per row: through explode they stay a plain
    # column, where a projection would be repeated in every filter and pattern.
    once = name in ("logs", "loudnorm_logs")
    form = lambda c, e: f"explode(array({e})) as `{c}`" if once and c in ("line", "log") else f"{e} as `{c}`"
    return df.selectExpr(*[form(c, _fill(e, SPARK)) for c, e in columns.items()])


def check_sql(body: str, *views: str) -> str:
    """``body`` preceded by the definitions of the views it reads."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        if name in NUMBERED:
            need(NUMBERED[name][0])
        elif name in VIEWS:
            need(VIEWS[name][0])
        else:
            return
        order.append(name)

    for v in views:
        need(v)
    parts = []
    for name in order:
        if name in NUMBERED:
            parts.append(f"{name} as ({NUMBERED[name][1]})")
            continue
        source, columns, keep = VIEWS[name]
        cols = ", ".join(f'{_fill(e, DUCK)} as "{c}"' for c, e in columns.items())
        where = f" where {_fill(keep, DUCK)}" if keep else ""
        parts.append(f"{name} as (select {cols} from {source}{where})")
    text = body.strip()
    if not parts:
        return text
    if text.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + text[5:]
    return "with " + ",\n".join(parts) + "\n" + text

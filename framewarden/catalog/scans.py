"""Sources and sinks.  Documents are rendered from the tables and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks.picture import structure_metrics
from ..fixtures import check_sql, load
from ..operators.events import datavyu_rows, describe_events, executive_summary, normalize_event_time
from ..operators.intervals import stitch_events
from ..operators.verdicts import overall_status
from ..plans.master import module_table
from ..profiles import COLUMNS, join_profile, profiles_table
from ..session import shared_dir
from ..sources import master_store, readers, writers
from . import CHECKS, QUERIES, query
from .profile_rows import PROFILE_ROWS


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def registered(name: str, *views: str, sql: str | None = None):
    """As ``query`` for functions of ``(spark, sf_dir)``."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = check_sql(sql, *views)
        return fn

    return keep


@registered(
    "scan_media_manifest", "orders",
    sql="""select distinct 'month=' || strftime(cast(o_orderdate as date), '%Y-%m') as folder, '.parquet' as suffix, 1 as n_files from orders""",
)
def scan_media_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by month, one file each, and the folders listed again."""
    path = scratch(spark, "manifest")
    orders = load(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    orders.repartition("month").write.partitionBy("month").parquet(path)
    files = readers.scan_media_manifest(spark, path, (".parquet",))
    folder = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(folder.alias("folder"), "suffix").agg(F.count(F.lit(1)).cast("int").alias("n_files"))


def nest_probes(flat: DataFrame) -> DataFrame:
    """Flat probe columns as the probe document's ``format`` and ``streams``."""
    tenths = lambda c: F.format_string("%d.%d", F.floor(F.col(c) / 10), F.col(c) % 10)
    none = F.lit(None).cast("string")

    def stream(kind: str, **over):
        names = ("width", "height", "duration", "sample_aspect_ratio", "display_aspect_ratio", "channels", "bit_rate")
        language = over.pop("language", none)
        cols = [F.lit(kind).alias("codec_type")] + [over.get(n, none).cast("string").alias(n) for n in names]
        tags = F.when(language.isNotNull(), F.create_map(F.lit("language"), language)).otherwise(
            F.create_map().cast("map<string,string>")
        )
        return F.struct(*cols, tags.alias("tags"))

    video = F.when(
        F.col("has_video"),
        F.array(stream("video", width=F.col("width"), height=F.col("height"), duration=tenths("stream_tenths"),
                       sample_aspect_ratio=F.col("sar"), display_aspect_ratio=F.col("dar"), language=F.col("v_lang"))),
    )
    sound = F.array_repeat(stream("audio", channels=F.lit(2), language=F.col("a_lang")), F.col("n_audio").cast("int"))
    subs = F.array_repeat(stream("subtitle"), F.col("n_subs").cast("int"))
    empty = F.slice(F.array(stream("video")), 1, 0)
    container = F.when(
        F.col("header_ok"),
        F.struct(F.col("container").alias("format_name"), tenths("dur_tenths").alias("duration"),
                 F.col("bit_rate").cast("string").alias("bit_rate")),
    )
    return flat.select(
        "file_id", "mode", "intact", "header_ok", container.alias("format"),
        F.concat(F.coalesce(video, empty), sound, subs).alias("streams"),
    )


@query(
    "read_probes", "probes_flat",
    sql="""select file_id, header_ok, case when has_video then 1 else 0 end as n_video, n_audio, n_subs,
       case when header_ok then container end as container, case when has_video then width end as width,
       case when has_video then v_lang end as language
       from probes_flat""",
)
def read_probes(flat: DataFrame) -> DataFrame:
    texts = nest_probes(flat).select("file_id", F.to_json(F.struct("format", "streams")).alias("text"))
    probes = structure_metrics(readers.parse_probes(texts))
    first = F.get(F.filter("streams", lambda s: s["codec_type"] == "video"), 0)
    return probes.select(
        "file_id", "header_ok",
        F.col("track_count_video").alias("n_video"), F.col("track_count_audio").alias("n_audio"),
        F.col("track_count_subs").alias("n_subs"), "container",
        first["width"].try_cast("int").alias("width"),
        F.try_element_at(first["tags"], F.lit("language")).alias("language"),
    )


def nest_reports(flat: DataFrame) -> DataFrame:
    """Flat report columns as report documents with top-level and nested events."""
    ev = F.struct("type", "start_time", "end_time")
    many = lambda n: F.array_repeat(ev, F.col(n))
    doc = F.struct(
        F.when(F.col("report_ord") % 10 != 0, F.col("module")).alias("module"),
        F.lit("WARNING").alias("status"),
        "segment_offset_sec",
        many("n_top").alias("events"),
        F.struct(many("n_nested").alias("events"), F.lit(0.5).alias("score")).alias("details"),
    )
    text = F.when(F.col("report_ord") % 50 == 7, F.lit('{"module": ')).otherwise(F.to_json(doc))
    return flat.select("file_id", "report_ord", F.lit("report_x").alias("report_name"), text.alias("text"))


@query(
    "read_reports", "docs_flat",
    sql="""select file_id, case when report_ord % 10 <> 0 then module else 'report_x' end as module, count(*) as n,
       cast(sum(n_top) as bigint) as n_events, cast(sum(n_nested) as bigint) as n_nested
       from docs_flat where report_ord % 50 <> 7 group by 1, 2""",
)
def read_reports(flat: DataFrame) -> DataFrame:
    reports = readers.parse_reports(nest_reports(flat))
    return reports.groupBy("file_id", "module").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("events")).alias("n_events"),
        F.sum(F.size("details_events")).alias("n_nested"),
    )


@query(
    "read_frame_stats", "frames",
    sql="""select concat(cast(file_id as string), '-', cast(frame_idx // 256 as string)) as file_id, frame_idx % 256 as frame_idx,
       case when frame_idx % 9 = 0 then 0 else pts_us end as pts_us,
       case when frame_idx % 5 = 0 then 16 when frame_idx % 11 <> 0 then ymin end as ymin, case when frame_idx % 6 = 0 then 235 else ymax end as ymax,
       case when frame_idx % 7 = 0 then 0 else satmax end as satmax, vrep
       from frames""",
)
def read_frame_stats(frames: DataFrame) -> DataFrame:
    """Documents of 256 frames with some tags missing and some unreadable."""
    i = F.col("frame_idx")
    tag = lambda name, c, gone: F.when(~gone, F.struct(F.lit(name).alias("key"), c.cast("string").alias("value")))
    ymin = F.when(i % 11 == 0, F.lit("n/a")).otherwise(F.col("ymin").cast("string"))
    never = F.lit(False)
    tags = F.map_from_entries(
        F.array_compact(F.array(
            tag("YMIN", ymin, i % 5 == 0), tag("YMAX", F.col("ymax"), i % 6 == 0),
            tag("SATMAX", F.col("satmax"), i % 7 == 0), tag("lavfi.signalstats.VREP", F.col("vrep"), never),
        ))
    )
    seconds = F.format_string("%d.%06d", F.floor(F.col("pts_us") / 1000000), F.col("pts_us") % 1000000)
    one = F.to_json(F.struct(F.when(i % 9 != 0, seconds).alias("pkt_pts_time"), tags.alias("tags")))
    docs = frames.groupBy("file_id", F.floor(i / 256).alias("c")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), one.alias("f")))), lambda e: e["f"]), ","
        ).alias("body")
    )
    name = F.concat(F.col("file_id").cast("string"), F.lit("-"), F.col("c").cast("string"))
    text = F.concat(F.lit('{"frames": ['), "body", F.lit("]}"))
    return readers.parse_frame_stats(docs.select(name.alias("file_id"), text.alias("text")))


@registered(
    "read_logs", "logs",
    sql="""select cast(file_id as varchar) as log, row_number() over (partition by file_id order by line_no) - 1 as line_no, line from logs""",
)
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as text files, one a media file, and read again."""
    path = scratch(spark, "logs")
    lines = load(spark, sf_dir, "logs").select("file_id", "line_no", "line")
    # One writer a log keeps its lines in one file.
    ordered = lines.repartition("file_id").sortWithinPartitions("file_id", "line_no")
    ordered.select("file_id", "line").write.partitionBy("file_id").text(path)
    files = readers.read_logs(spark, path, "*.txt")
    return files.select(F.regexp_extract("folder", "file_id=(.*)$", 1).alias("log"), "line_no", "line")


@query(
    "split_lines", "loudnorm_logs",
    sql="""select file_id, cast(generate_subscripts(l, 1) - 1 as bigint) as line_no, unnest(l) as line
       from (select file_id, string_split(log, chr(10)) as l from loudnorm_logs) t""",
)
def split_lines(docs: DataFrame) -> DataFrame:
    return readers.split_lines(docs, "log")


@registered(
    "read_segment_list", "segment_events",
    sql="""select concat('seg_', cast(file_id as string), '_', cast(segment_id as string), '.mp4') as name, segment_start as start_time
       from segment_events group by 1, 2""",
)
def read_segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "segment_events").select("file_id", "segment_id", "segment_start").distinct()
    name = F.concat_ws("_", F.lit("seg"), "file_id", "segment_id")
    path = scratch(spark, "segment-list")
    rows.select(F.concat(name, F.lit(".mp4")), "segment_start", F.col("segment_start") + 6.0).write.csv(path)
    return readers.read_segment_list(spark, path)


@registered("read_jobs", "jobs", sql="select id, original_filename, status, created_at, fix_status from jobs")
def read_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jobs")
    load(spark, sf_dir, "jobs").write.parquet(path)
    return readers.read_jobs(spark, path).select("id", "original_filename", "status", "created_at", "fix_status")


_STITCHED = """
, marks as (select *, max(end_time) over (partition by file_id, type order by start_time, ord rows between unbounded preceding and 1 preceding) as reach from timeline),
isl as (select *, sum(case when reach is null or start_time > reach + 0.1e0 then 1 else 0 end) over (partition by file_id, type order by start_time, ord rows unbounded preceding) as id from marks),
stitched as (select file_id, type, id, min(start_time) as start_time, max(end_time) as end_time, count(*) as n_events,
  first(severity order by start_time, ord) as severity,
  list_reduce(list(details order by start_time, ord), lambda a, x: case when contains(a, x) then a else concat(a, ' | ', x) end) as details
  from isl group by file_id, type, id)
"""


@registered(
    "write_master", "timeline", "reports",
    sql=f"""with v as (select file_id, count(distinct module) as n_modules,
         max(case status when 'REJECTED' then 3 when 'WARNING' then 2 else 1 end) as r from reports group by file_id)
       {_STITCHED}
       select cast(v.file_id as bigint) as file_id, case r when 3 then 'REJECTED' when 2 then 'WARNING' else 'PASSED' end as overall_status,
       n_modules, (select count(*) from stitched s where s.file_id = v.file_id) as n_events,
       coalesce((select sum(s.end_time) from stitched s where s.file_id = v.file_id and s.end_time < 1), 0.0e0) as early_end,
       (select cast(sum(w) as double) from (select module, arg_max(ord, (ord, report_id)) as w from reports r where r.file_id = v.file_id group by module) t) as metric_sum
       from v""",
)
def write_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the JSON master reports and read them back."""
    reports, timeline = load(spark, sf_dir, "reports"), load(spark, sf_dir, "timeline")
    reports = reports.withColumn("effective_status", F.lit(None).cast("string"))
    path = scratch(spark, "master")
    numbered = reports.withColumn("metrics", F.create_map(F.lit("ord"), F.col("ord").cast("double"))).withColumn("ord", F.struct("ord", "report_id"))
    writers.write_master(overall_status(reports), module_table(numbered), stitch_events(timeline), path)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    files = read("files", "file_id long, overall_status string")
    modules = read("modules", "file_id long, module string, status string, metrics map<string,double>").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_modules"), F.sum(F.try_element_at("metrics", F.lit("ord"))).alias("metric_sum")
    )
    events = read("events", "file_id long, start_time double, end_time double, type string").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("end_time") < 1, F.col("end_time"))).alias("early_end")
    )
    return files.join(modules, "file_id", "left").join(events, "file_id", "left").select(
        "file_id", "overall_status", "n_modules", F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("early_end", F.lit(0.0)).alias("early_end"), "metric_sum",
    )


@registered(
    "master_commits", "timeline", "reports",
    sql="""with v as (select file_id, count(distinct module) as n_modules,
         max(case status when 'REJECTED' then 3 when 'WARNING' then 2 else 1 end) as r from reports group by file_id)
       select cast(v.file_id as bigint) as file_id, case r when 3 then 'REJECTED' when 2 then 'WARNING' else 'PASSED' end as overall_status, n_modules,
       case when r = 1 then 1 else 2 end as commits, (select count(*) from timeline t where t.file_id = v.file_id) as n_events from v""",
)
def master_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files committed as passed, then those with findings once more as they are; a third run is lost before its manifest."""
    reports, timeline = load(spark, sf_dir, "reports"), load(spark, sf_dir, "timeline").select("file_id", "start_time", "type")
    reports = reports.withColumn("effective_status", F.lit(None).cast("string"))
    path = scratch(spark, "commits")
    passed = reports.withColumn("status", F.lit("PASSED"))
    files = overall_status(reports).select("file_id", "overall_status")
    found = files.where("overall_status <> 'PASSED'")
    of = lambda df: df.join(found.select("file_id"), "file_id", "left_semi")
    modules = module_table(reports)
    master_store.commit_master(overall_status(passed).select("file_id", "overall_status"), module_table(passed), timeline, path)
    master_store.commit_master(found, of(modules), of(timeline), path)
    files.withColumn("overall_status", F.lit("LOST")).write.json(f"{path}/files/run=99999999999999999999-lost")
    schemas = {"files": "file_id long, overall_status string", "modules": "file_id long, module string, status string", "events": "file_id long, start_time double, type string"}
    tables = master_store.read_master(spark, path, schemas)
    runs = spark.read.schema("file_id long, run string").json(f"{path}/{master_store.MANIFEST}").groupBy("file_id").agg(F.count("*").alias("commits"))
    counts = tables["modules"].groupBy("file_id").agg(F.count("*").alias("n_modules"))
    events = tables["events"].groupBy("file_id").agg(F.count("*").alias("n_events"))
    return tables["files"].join(counts, "file_id").join(runs, "file_id").join(events, "file_id", "left").select(
        "file_id", "overall_status", "n_modules", "commits", F.coalesce("n_events", F.lit(0)).alias("n_events")
    )


@registered(
    "write_datavyu", "timeline",
    sql="""select cast(file_id as bigint) as file_id, cast(trunc(start_time * 1000) as bigint) as onset,
       cast(trunc(end_time * 1000) as bigint) as "offset",
       'GEN' as code01, severity as code02, concat(upper(type[1]), type[2:], ': ', details) as comment from timeline""",
)
def write_datavyu(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "timeline").withColumn("timestamp", F.col("start_time"))
    path = scratch(spark, "datavyu")
    writers.write_datavyu(datavyu_rows(describe_events(normalize_event_time(events))), path)
    return spark.read.schema("onset long, offset long, code01 string, code02 string, comment string, file_id long").option(
        "header", "true"
    ).csv(path)


@registered(
    "write_executive_summary", "batch_results", "found_types",
    sql="""with t as (select name, list(distinct type order by type) as ty from found_types group by name)
       select filename as "Filename", status as "Status", nullif(coalesce(array_to_string(ty, ', '), ''), '') as "Defects",
       duration as "Duration (s)" from batch_results left join t on name = file_id""",
)
def write_executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = load(spark, sf_dir, "batch_results")
    events = load(spark, sf_dir, "found_types").withColumnRenamed("name", "file_id")
    path = scratch(spark, "summary")
    writers.write_executive_summary(executive_summary(results, events), path)
    return spark.read.schema("Filename string, Status string, Defects string, `Duration (s)` long").option(
        "header", "true"
    ).csv(path)


@registered(
    "profiles_table", "orders",
    sql=f"""select p.*, n.n_files from ({PROFILE_ROWS}) as p({', '.join(c for c, _ in COLUMNS)})
       join (select case o_custkey % 5 when 1 then 'netflix_hd' when 2 then 'youtube' when 3 then 'ott' else 'strict' end as profile,
       count(*) as n_files from orders group by 1) n on n.profile = p.profile""",
)
def profiles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile dimension with the number of files that resolve to each; an unknown name counts for ``strict``."""
    table = profiles_table(spark)
    files = join_profile(load(spark, sf_dir, "mixed_reports").select("file_id", "profile"), table.select("profile"))
    asked = files.groupBy(F.col("resolved_profile").alias("profile")).agg(F.count(F.lit(1)).alias("n_files"))
    return table.join(asked, "profile")

"""Orders, samples, generators, set operations and the check registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import events as ev
from ..operators import frames as fr
from ..operators import jobs as jb
from ..operators.folding import Validator, map_segments
from ..operators.ledger import work_states
from ..operators.segments import assign_segment, plan_segments
from ..operators.verdicts import contract_violations, crash_reports, missing_keys
from ..plans.checks import CHECKS as REGISTRY
from ..plans.checks import report_rows, run_checks
from ..plans.master import report_events
from ..sources.readers import parse_reports
from . import query
from .aggregates import DESCRIBED_SQL, smpte_sql
from .rules import _KEYS
from .scans import nest_reports


@query("timeline_order", "timeline", sql="select file_id, ord, type, start_time from timeline order by start_time, type")
def timeline_order(timeline):
    return ev.timeline_order(timeline.select("file_id", "ord", "type", "start_time"))


@query("failures_first", "batch_results", sql="select filename, status, duration from batch_results order by status = 'PASSED', filename")
def failures_first(results):
    return ev.failures_first(results.select("filename", "status", "duration"))


@query("jobs_newest_first", "jobs", sql="select id, status, created_at from jobs order by created_at desc, id")
def newest_first(jobs):
    return jb.jobs_newest_first(jobs.select("id", "status", "created_at"))


@query(
    "first_k_times", "worded",
    sql=f"""with {DESCRIBED_SQL}, r as (select *, row_number() over (partition by file_id, human_name order by start_time, ord) as nth from described)
       select file_id, human_name, nth, start_time, {smpte_sql('start_time')} as smpte from r where nth <= 3""",
)
def first_times(worded):
    return ev.first_k_times(ev.describe_events(ev.normalize_event_time(worded))).drop("category")


@query("sample_every_nth", "frames", sql="select file_id, frame_idx, pts_us from frames where frame_idx % 5 = 0 and frame_idx <= 25.0e0 * 30")
def sample(frames):
    return fr.sample_every_nth(frames, 5, first_seconds=30).select("file_id", "frame_idx", "pts_us")


@query(
    "sampling_step", "orders",
    sql="""select o_orderkey as file_id, greatest(1, cast(round_even((20 + o_custkey % 41) / 2.0e0 / (1 + o_orderkey % 3), 0) as int)) as step from orders""",
)
def step(orders):
    fps, rate = (F.lit(20) + F.col("o_custkey") % 41) / 2.0, F.lit(1) + F.col("o_orderkey") % 3
    return orders.select(F.col("o_orderkey").alias("file_id"), fr.sampling_step(fps, rate).alias("step"))


@query("timeseries_thin", "frames", sql="select file_id, frame_idx, pts_us / 1e6 as t, vrep as val from frames where vrep > 2.0e0")
def thin(frames):
    return fr.timeseries_thin(frames)


@query("micro_batch_limit", "frames", sql="select file_id, frame_idx, vrep from frames where frame_idx < 750")
def micro_batch(frames):
    return fr.micro_batch_limit(frames).select("file_id", "frame_idx", "vrep")


@query(
    "plan_segments", "probes_flat",
    sql="""with f as (select file_id, dur_tenths / 10.0e0 as d, unnest(range(0, cast(ceil(dur_tenths / 10.0e0 / 300.0e0) as bigint))) as i from probes_flat where dur_tenths > 0)
       select file_id, cast(i as int) as segment_id, i * 300.0e0 as start_time, least(300.0e0, d - i * 300.0e0) as duration from f""",
)
def segments(flat):
    return plan_segments(flat.select("file_id", (F.col("dur_tenths") / 10.0).alias("duration_sec")))


@query("assign_segment", "frames", sql="select file_id, frame_idx, cast(floor(pts_us / 1e6 / 6.0e0) as int) as segment_id from frames")
def assign(frames):
    return frames.select("file_id", "frame_idx", assign_segment(F.col("pts_us") / 1e6, 6.0).alias("segment_id"))


@query(
    "pending_jobs", "jobs",
    sql="""select id, 'analysis' as queue from jobs where status = 'QUEUED' union all select id, 'repair' from jobs where fix_status = 'QUEUED'""",
)
def pending(jobs):
    return jb.pending_jobs(jobs).select("id", "queue")


COLLECTED_SQL = """ev as (select file_id, report_ord, unnest(range(0, n_top + n_nested)) as pos,
   case when report_ord % 10 <> 0 then module else 'report_x' end as source_module, type,
   start_time + segment_offset_sec as start_time, end_time + segment_offset_sec as end_time from docs_flat where report_ord % 50 <> 7)"""


def documents(flat: DataFrame) -> DataFrame:
    # The position of the report stands in for its file name order.
    docs = nest_reports(flat).withColumn("file_id", F.concat_ws("/", "file_id", "report_ord"))
    parts = F.split("file_id", "/")
    return parse_reports(docs).withColumns(
        {"file_id": F.get(parts, 0).cast("long"), "report_ord": F.get(parts, 1).cast("long")}
    )


@query("collect_events", "docs_flat", sql=f"with {COLLECTED_SQL} select * from ev")
def collected(flat):
    events = report_events(documents(flat))
    return events.select(
        "file_id", "report_ord", F.col("pos").cast("long").alias("pos"), "source_module", "type", "start_time", "end_time"
    )


@query(
    "missing_keys", "mixed_reports",
    sql="""select file_id, ord, array_to_string(list_filter([case when not has_video_file then 'video_file' end, case when status is null then 'status' end,
         case when not has_metrics then 'metrics' end], lambda v: v is not null), ',') as missing from mixed_reports
       where not has_video_file or status is null or not has_metrics""",
)
def missing(reports):
    there = {"video_file": F.col("has_video_file"), "metrics": F.col("has_metrics"), "status": F.col("status").isNotNull()}
    keys = F.array_compact(F.array(*[F.when(there.get(k, F.lit(True)), F.lit(k)) for k in _KEYS]))
    gone = reports.withColumn("missing", missing_keys(keys)).where(F.size("missing") > 0)
    return gone.select("file_id", "ord", F.array_join("missing", ",").alias("missing"))


@query("distinct_types", "found_types", sql="select distinct name as file_id, type from found_types")
def types(found):
    return ev.distinct_types(found.withColumnRenamed("name", "file_id"))


def _over_range(state, batch):
    """Rows, and rows over range."""
    return state[0] + len(batch), state[1] + int((batch["ymax"] > 235).sum())


def _both(a, b):
    return a[0] + b[0], a[1] + b[1]


def _loud(state) -> str:
    return "REJECTED" if state[1] * 10 > state[0] * 4 else "PASSED"


def _top(state, batch):
    return max(state, int(batch["satmax"].max()))


def _fragile(top) -> str:
    if top > 350:
        raise ValueError("saturation out of range")
    return "PASSED"


_SEGMENT_VALIDATORS = {
    "loud": Validator(lambda: (0, 0), _over_range, _both, _loud),
    "fragile": Validator(lambda: 0, _top, max, _fragile),
}


@query(
    "map_segments", "frames",
    sql="""with s as (select file_id, cast(floor(pts_us / 1e6 / 6.0e0) as int) as segment_id, count(*) as n, count(*) filter (ymax > 235) as bad, max(satmax) as top from frames group by 1, 2)
       select file_id, segment_id, 'loud' as module, case when bad * 10 > n * 4 then 'REJECTED' else 'PASSED' end as status, null as error from s
       union all select file_id, segment_id, 'fragile', case when top > 350 then 'CRASHED' else 'PASSED' end, case when top > 350 then 'saturation out of range' end from s""",
)
def mapped(frames):
    rows = frames.select("file_id", assign_segment(F.col("pts_us") / 1e6, 6.0).alias("segment_id"), "frame_idx", "ymax", "satmax")
    return map_segments(rows, _SEGMENT_VALIDATORS, order="frame_idx")


@query(
    "check_reports", "frames",
    sql="""with s as (select file_id, least(255, min(ymin)) as lo, greatest(0, max(ymax)) as hi, count(*) as n from frames group by 1)
       select file_id, cast(lo as double) as signal_min_y, cast(hi as double) as signal_max_y, cast(n as double) as total_frames, false as broken from s""",
)
def check_reports(frames):
    """Metrics of the signal check's reports, which keep the report contract."""
    reports = report_rows(run_checks(REGISTRY, {"frames": frames}, "strict", ("validate_signal",)))
    broken = contract_violations(reports).select("file_id", F.lit(True).alias("broken"))
    number = lambda n: F.try_element_at("metrics", F.lit(n)).alias(n)
    return reports.join(broken, "file_id", "left").select(
        "file_id", number("signal_min_y"), number("signal_max_y"), number("total_frames"), F.coalesce("broken", F.lit(False)).alias("broken")
    )


@query(
    "crash_report", "mixed_reports",
    sql="""with m as (select unnest(['validate_0', 'validate_1', 'validate_2', 'validate_3', 'validate_4', 'validate_5']) as module),
       f as (select distinct file_id from mixed_reports)
       select file_id, module, 'CRASHED' as status from f, m where not exists (select 1 from mixed_reports r where r.file_id = f.file_id and r.module = m.module)""",
)
def crashed(reports):
    files = reports.select("file_id").distinct()
    return crash_reports(files, reports, [f"validate_{i}" for i in range(6)]).select("file_id", "module", "status")


_LEDGER_SQL = """l as (select file_id, module, case when report_id % 5 = 0 then 'old' else 'now' end as config_hash, report_id as attempt,
   case when report_id % 3 = 0 then 'CRASHED' when report_id % 7 <> 0 then status end as status from reports),
 e as (select distinct f.file_id, m.module, 'now' as config_hash from (select file_id from reports) f, (select distinct module from reports union all select 'validate_new') m),
 s as (select file_id, module, config_hash, count(distinct attempt) as attempts, bool_or(coalesce(status <> 'CRASHED', false)) as done from l group by all)"""


@query(
    "work_states", "reports",
    sql=f"""with {_LEDGER_SQL} select e.file_id, e.module, e.config_hash, coalesce(attempts, 0) as attempts,
       case when done then 'DONE' when attempts >= 3 then 'CRASHED' when attempts > 0 then 'REPEAT' else 'RUN' end as state
       from e left join s using (file_id, module, config_hash)""",
)
def states(reports):
    """Every report of the table as an attempt; some failed, some under an older configuration."""
    turn = F.col("report_id")
    entries = reports.select(
        "file_id", "module", F.when(turn % 5 == 0, "old").otherwise("now").alias("config_hash"), turn.alias("attempt"),
        F.when(turn % 3 == 0, "CRASHED").when(turn % 7 != 0, F.col("status")).alias("status"),
    )
    modules = reports.select("module").distinct().groupBy().agg(F.collect_set("module").alias("m"))
    names = F.concat(F.lit(modules.first()["m"]), F.array(F.lit("validate_new")))
    expected = reports.select("file_id").distinct().select("file_id", F.explode(names).alias("module"), F.lit("now").alias("config_hash"))
    return work_states(expected, entries)

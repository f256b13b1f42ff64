"""Master reports as a store that is committed file by file.

A run writes its rows of the three tables to folders of its own and a manifest
last: a row for each file with the run that holds it.  Readers go by the manifest
alone, so a rerun of some files leaves all others as they are, and a run that is
lost before its manifest leaves nothing that can be seen.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables, and the order of their rows.
TABLES = {"files": ("file_id",), "modules": ("file_id", "module"), "events": ("file_id", "start_time")}
MANIFEST = "manifest"


def commit_master(files: DataFrame, modules: DataFrame, events: DataFrame, path: str) -> str:
    """Adds the files of ``files`` to the store, in place of what it held of them; the name of the run.

    ``files`` has a row a file, ``modules`` one for each of its reports, ``events``
    its timeline; a file without modules or events has none of them.  Runs that
    overlap in time do not mix: of a file the run that began last counts.
    """
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for (name, order), df in zip(TABLES.items(), (files, modules, events), strict=True):
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(f"{path}/{name}/run={run}")
    known = ["file_id", *[c for c in ("config_version_hash",) if c in files.columns]]
    # From the written rows, so that the manifest lists what is there.
    written = files.sparkSession.read.schema(files.schema).json(f"{path}/files/run={run}").select(*known)
    written.withColumn("committed_at", F.current_timestamp()).write.json(f"{path}/{MANIFEST}/run={run}")
    return run


def manifest(spark: SparkSession, path: str, file_type: str = "bigint") -> DataFrame:
    """``file_id, run, config_version_hash, committed_at`` of every file: the last run that committed it."""
    rows = spark.read.schema(f"file_id {file_type}, config_version_hash string, committed_at timestamp, run string").json(f"{path}/{MANIFEST}")
    last = F.max(F.struct("run", "config_version_hash", "committed_at")).alias("last")
    return rows.groupBy("file_id").agg(last).select("file_id", "last.*")


def read_master(spark: SparkSession, path: str, schemas: dict[str, str], file_type: str = "bigint") -> dict[str, DataFrame]:
    """The store's tables with the given schemas, each file as its last run left it."""
    live = manifest(spark, path, file_type).select("file_id", "run")
    return {
        name: spark.read.schema(f"{schema}, run string").json(f"{path}/{name}").join(live, ["file_id", "run"], "left_semi").drop("run")
        for name, schema in schemas.items()
    }


def master_document(tables: dict[str, DataFrame], file_id) -> DataFrame:
    """The one document of one file, as a row with ``document``: header, modules by name and events in order of time.

    For a file whose document fits a row; longer ones stay tables.
    """
    one = {name: df.where(F.col("file_id") == F.lit(file_id)) for name, df in tables.items()}
    modules = one["modules"].groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("module", F.struct(*[c for c in one["modules"].columns if c not in ("file_id", "module")]).alias("report")))).alias("m")
    ).select("file_id", F.map_from_entries("m").alias("modules"))
    columns = [c for c in one["events"].columns if c != "file_id"]
    order = [c for c in ("start_time", "end_time", "type") if c in columns]
    events = one["events"].groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("aggregated_events")
    )
    whole = one["files"].join(modules, "file_id", "left").join(events, "file_id", "left")
    return whole.select("file_id", F.to_json(F.struct(*whole.columns)).alias("document"))

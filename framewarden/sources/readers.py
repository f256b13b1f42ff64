"""Readers.  Logs are read line by line, in blocks.  A JSON document is one row,
since it cannot be split; convert large libraries to Parquet once and run the
operators on that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.chunks import numbered

# Media file suffixes; the batch tool also takes ``.ts``.
MEDIA_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".mxf")
BATCH_SUFFIXES = (*MEDIA_SUFFIXES, ".ts")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def scan_media_manifest(spark: SparkSession, folder: str, suffixes=MEDIA_SUFFIXES) -> DataFrame:
    """Media files below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.where(suffix.isin(*suffixes)).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), suffix.alias("suffix"),
        "length", "modificationTime",
    )


def read_texts(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Whole documents as ``file_id`` (stem), ``folder``, ``text``."""
    docs = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", "true").text(folder, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    return docs.select(_stem(path).alias("file_id"), _folder(path).alias("folder"), F.col("value").alias("text"))


def _parsed(docs: DataFrame, schema: str) -> DataFrame:
    """``doc`` next to the other columns; documents that are not JSON are skipped."""
    doc = F.from_json("text", f"struct<{_colons(schema)},_corrupt_record:string>")
    return (
        docs.withColumn("doc", F.explode(F.array(doc)))
        .where(F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull())
        .drop("text")
    )


def _colons(schema: str) -> str:
    return schemas.struct_of(schema)[len("struct<"):-1]


def parse_reports(docs: DataFrame) -> DataFrame:
    """Check reports from ``file_id, report_name, text``.

    ``module`` falls back to the report's own name.
    """
    rows = _parsed(docs, schemas.REPORT).select("file_id", "report_name", "doc.*").drop("_corrupt_record")
    nested = F.from_json("details", f"struct<events:{schemas.EVENT_ARRAY}>")["events"]
    return rows.withColumns(
        {
            "module": F.coalesce("module", "report_name"),
            "details_events": nested,
            "details": F.from_json("details", "map<string,string>"),
        }
    )


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Check reports, one folder per media file."""
    docs = read_texts(spark, folder)
    return parse_reports(docs.select(F.col("folder").alias("file_id"), F.col("file_id").alias("report_name"), "text"))


def parse_probes(docs: DataFrame) -> DataFrame:
    """Container and stream metadata from ``file_id, text``; other columns stay.

    Numbers stay text until a check needs them.  A document that is not JSON or
    has no ``format`` part has an unreadable header.
    """
    doc = F.from_json("text", f"struct<{_colons(schemas.PROBE)}>")
    streams = F.coalesce(F.col("doc.streams"), F.array().cast(f"array<{schemas.struct_of(schemas.STREAM)}>"))
    # Through explode the text is parsed once for all of the columns.
    return docs.withColumn("doc", F.explode(F.array(doc))).withColumns(
        {"format": F.col("doc.format"), "streams": streams, "header_ok": F.col("doc.format").isNotNull()}
    ).drop("doc", "text")


def read_probes(spark: SparkSession, folder: str) -> DataFrame:
    return parse_probes(read_texts(spark, folder).select("file_id", "text"))


def frame_tags(frame: Column) -> dict[str, Column]:
    """Typed measurements of one frame; a *present* tag that is no number gives null."""
    tags = frame["tags"]

    def tag(name: str, kind: str, default) -> Column:
        text = F.try_element_at(tags, F.lit(name))
        return F.when(text.isNull(), F.lit(default).cast(kind)).otherwise(text.try_cast(kind))

    seconds = F.coalesce(frame["pkt_pts_time"].try_cast("double"), F.lit(0.0))
    return {
        "pts_us": F.round(seconds * 1e6).cast("long"),
        "ymin": tag("YMIN", "int", 16),
        "ymax": tag("YMAX", "int", 235),
        "satmax": tag("SATMAX", "int", 0),
        "vrep": tag("lavfi.signalstats.VREP", "double", 0.0),
    }


def explode_frames(docs: DataFrame) -> DataFrame:
    """``file_id, frames`` documents to one row per frame, counted from 0.

    A frame whose tag is no number keeps its row with a null there, and each
    check passes over what it cannot read.
    """
    rows = docs.select("file_id", F.posexplode("frames").alias("frame_idx", "_f"))
    cols = frame_tags(F.col("_f"))
    return rows.select("file_id", F.col("frame_idx").cast("long").alias("frame_idx"), *[c.alias(n) for n, c in cols.items()])


def parse_frame_stats(docs: DataFrame) -> DataFrame:
    """Frame measurements from ``file_id, text``."""
    return explode_frames(_parsed(docs, schemas.FRAME_STATS).select("file_id", "doc.frames"))


def read_frame_stats(spark: SparkSession, folder: str) -> DataFrame:
    return parse_frame_stats(read_texts(spark, folder).select("file_id", "text"))


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whole texts to numbered lines; the order of lines is data."""
    return docs.select("file_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def read_logs(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """``file_id`` (stem), ``folder, line_no, line``; a long log is read in blocks by several tasks.

    Lines are counted within their block first; the blocks before it add theirs.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", "true").text(folder)
    )
    placed = lines.select(
        _stem(F.col("_metadata.file_path")).alias("file_id"), _folder(F.col("_metadata.file_path")).alias("folder"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"),
    )
    counted = numbered(placed, ["folder", "file_id"], F.col("block"), ["pos"], "line_no")
    return counted.select("file_id", "folder", "line_no", "line")


def read_segment_list(spark: SparkSession, path: str) -> DataFrame:
    """Segment names and start times; blank rows are skipped."""
    return spark.read.schema(schemas.SEGMENT_LIST).csv(path).where(F.col("name").isNotNull()).select("name", "start_time")


# What lets Spark read a table over JDBC in several tasks.
JDBC_BOUNDS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def read_jobs(spark: SparkSession, path: str | None = None, **jdbc) -> DataFrame:
    """The job table: Parquet at ``path``, or JDBC options (``url, dbtable, ...``).

    JDBC needs the bounds of its partition column, or one task would read it all.
    """
    if path is not None:
        return spark.read.parquet(path)
    missing = [b for b in JDBC_BOUNDS if b not in jdbc]
    if missing:
        raise ValueError("JDBC options missing: " + ", ".join(missing))
    return spark.read.format("jdbc").options(**jdbc).load()

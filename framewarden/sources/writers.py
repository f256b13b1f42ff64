"""Writers.  All are ordinary distributed Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_master(files: DataFrame, modules: DataFrame, events: DataFrame, path: str) -> None:
    """Master documents as JSON lines in three folders, whatever a file's length.

    ``files`` has a header row a file (verdict, governance, licences), ``modules``
    a row for each report with its metrics, ``events`` the stitched timeline.
    Rows are ranged by file, events also by time: a long file spreads over
    several part files, short ones share them.
    """
    for name, df, order in (
        ("files", files, ["file_id"]), ("modules", modules, ["file_id", "module"]), ("events", events, ["file_id", "start_time"])
    ):
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path}/{name}")


def write_datavyu(rows: DataFrame, path: str) -> None:
    """One folder of annotation rows per file, with header.

    Rows are ranged by file and onset: a long file spreads over several writers,
    a short one stays in one.
    """
    ranged = rows.repartitionByRange("file_id", "onset").sortWithinPartitions("file_id", "onset")
    ranged.select("file_id", "onset", "offset", "code01", "code02", "comment").write.mode("overwrite").partitionBy(
        "file_id"
    ).option("header", "true").csv(path)


def write_executive_summary(summary: DataFrame, path: str) -> None:
    """Batch outcome, failures first; part files follow the sort order."""
    columns = {
        "filename": "Filename", "status": "Status", "defects": "Defects", "duration": "Duration (s)",
    }
    ordered = summary.orderBy(F.col("status") == "PASSED", "filename")
    ordered.select(*[F.col(c).alias(n) for c, n in columns.items()]).write.mode("overwrite").option(
        "header", "true"
    ).csv(path)

"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed value: characters between words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewarden-llm-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACES), "")


def bounded_rows(spark: SparkSession, rows: Iterable[tuple], schema: str, most: int) -> DataFrame:
    """A small driver-side table for a broadcast; refuses more than ``most`` rows."""
    rows = list(rows)
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows, at most {most} may be broadcast")
    return F.broadcast(spark.createDataFrame(rows, schema))


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)

"""Captures and list events that the query derives from ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filters import host_of, path_of

DAY = 86_400


def captures_of(pages: DataFrame) -> DataFrame:
    """A page is fetched on day ``page_id mod 60``, at a second that its id gives."""
    return pages.select(
        F.col("page_id").alias("capture_id"), "url",
        (F.pmod("page_id", F.lit(60)) * DAY + F.pmod(F.col("page_id") * 7919, F.lit(DAY))).alias("fetched_at"),
    )


def checksum(name: Column) -> Column:
    """The first 32 bits of an MD5 as a number."""
    return F.conv(F.substr(F.md5(name), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def events_of(pages: DataFrame) -> DataFrame:
    """Dated events of three lists, made from the hosts and first folders of all pages.

    A domain of three labels is put on ``ads`` if its checksum divides by 3, a
    host on ``malware`` if it leaves 1 by 5, a folder on ``adult`` if it leaves 2
    by 4.  The days follow from the checksums; every entry is removed again, and
    those with an even checksum come back for good.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''").distinct()
    named = (
        seen.select(F.lit("ads").alias("list"), F.lit("d:").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("name"))
        .union(seen.select(F.lit("malware"), F.lit("d:"), "host"))
        .union(seen.select(F.lit("adult"), F.lit("p:"), F.concat("host", F.regexp_extract("path", "^(/[^/]*/)", 1))).where("path rlike '^/[^/]*/'"))
    )
    known = named.where("name <> ''").distinct().withColumn("c", checksum(F.col("name")))
    known = known.where("(list = 'ads' and c % 3 = 0) or (list = 'malware' and c % 5 = 1) or (list = 'adult' and c % 4 = 2)")
    c = F.col("c")
    first = c % 40 * DAY
    event = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    steps = F.array(event("add", first), event("remove", first + (1 + c % 11) * DAY), event("add", first + (15 + c % 7) * DAY))
    dated = known.select("list", F.concat("kind", "name").alias("entry"), F.explode(F.when(c % 2 == 0, steps).otherwise(F.slice(steps, 1, 2))).alias("e"))
    return dated.select("list", "entry", "e.action", "e.at")

"""URL filters by a temporal list join, in column functions only.

List entries are added and removed at dates.  The events of an entry become
validity intervals; a capture is matched with the entries of its host, of every
domain above it and of every folder of its path that were active when it was
fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = 2**62


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and closing dot; empty where there is none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def path_of(url: Column) -> Column:
    """Path without query and fragment; ``/`` where there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise("/")


def entries_of(url: Column) -> Column:
    """All list entries that would cover a URL.

    ``d:`` and a domain covers it and its subdomains; ``p:``, a host and a path
    that ends in a slash covers what is below.
    """
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(labels, lambda x, i: F.concat(F.lit("d:"), F.concat_ws(".", F.slice(labels, i + 1, F.size(labels)))))
    parts = F.split(path_of(url), "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("p:"), host_of(url), F.concat_ws("/", F.slice(parts, 1, k)), F.lit("/"))
    )
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, folders)))


def validity(events: DataFrame) -> DataFrame:
    """``list, entry, start, stop`` of events ``list, entry, action, at``: half-open intervals.

    ``action`` is ``add`` or ``remove``; of events at one time a removal is
    first, so an entry removed and added at once stays.  An addition while
    active and a removal while not change nothing.  Rows with a null are left
    out, repeated rows count once.
    """
    known = events.select("list", "entry", "action", F.col("at").cast("bigint").alias("at")).dropna()
    known = known.where(F.col("action").isin("add", "remove"))
    # One row a time: the addition wins.
    state = known.groupBy("list", "entry", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    by_time = Window.partitionBy("list", "entry").orderBy("at")
    changes = state.withColumn("was", F.coalesce(F.lag("on").over(by_time), F.lit(0))).where("on <> was")
    changes = changes.withColumn("stop", F.coalesce(F.lead("at").over(by_time), F.lit(FOREVER)))
    return changes.where("on = 1").select("list", "entry", F.col("at").alias("start"), "stop")


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``capture_id, url, fetched_at, lists, entries, blocked`` of every row of ``captures``.

    ``lists`` are the lists with an entry active at ``fetched_at``, ``entries``
    those entries with their list; both sorted and without repeats.  A null URL,
    a null time or a URL without a host meets no entry.  The join is by entry:
    captures are first reduced to the distinct pairs of address and time, and an
    entry's intervals travel as one sorted row a list, so a hot host makes no
    more rows than it has distinct captures.
    """
    spans = validity(events).groupBy("list", "entry").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    asked = captures.select("url", F.col("fetched_at").cast("bigint").alias("at")).where("url is not null and at is not null").distinct()
    keys = asked.select("url", "at", F.explode(entries_of(F.col("url"))).alias("entry"))
    hits = keys.join(spans, "entry").where(
        F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") < s["stop"]))
    )
    told = hits.groupBy("url", "at").agg(
        F.sort_array(F.collect_set("list")).alias("lists"),
        F.sort_array(F.collect_set(F.concat_ws(" ", "list", "entry"))).alias("entries"),
    ).withColumnsRenamed({"url": "_url", "at": "_at"})
    rows = captures.select("capture_id", "url", F.col("fetched_at").cast("bigint").alias("fetched_at"))
    rows = rows.join(told, (F.col("url") == F.col("_url")) & (F.col("fetched_at") == F.col("_at")), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "capture_id", "url", "fetched_at", F.coalesce("lists", none).alias("lists"), F.coalesce("entries", none).alias("entries"),
        F.col("lists").isNotNull().alias("blocked"),
    )

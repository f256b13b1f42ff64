"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (columns ``u``, ``v``, integers) that is not its own smallest.

    The component is the smallest node reachable.  Every step is written to the
    shared folder, so no plan grows and lost executors cost one step.
    """
    pair = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    current = written(pair(edges), name)
    last = mark(current)
    while last[0]:
        current = written(pair(_small_star(pair(_large_star(current)))), name)
        now = mark(current)
        if now == last:
            break
        last = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))

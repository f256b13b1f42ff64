"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to.  A flow routes the words of the patterns to the sources' quotas; reading a
pattern again costs more each time.  Seeded thresholds then pick the documents
of a pattern, so a row's share of the mix is a function of the row and of a
table with one row a pattern.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_rows, text_of, written
from .flow import route

WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class Mix:
    """What decides a mix: by pattern the thresholds, by source its size and target."""

    seed: int
    picks: list[tuple]
    sources: dict
    names: dict[tuple, str]
    most_patterns: int


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def pattern_of(sources: Column) -> Column:
    """A membership array as text: sorted, each source once, a null source last."""
    return F.to_json(F.sort_array(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), {"ignoreNullFields": "false"})


def order_of(seed: int, doc_id: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, size)


def by_code_point(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> dict:
    """Target words of each source: ``share`` of all words by weight, at most ``epochs`` times its size,

    what exceeds that dealt anew by weight.  Sources take the weights in turn by
    code point, null last.
    """
    weight = {s: weights[i % len(weights)] for i, s in enumerate(by_code_point(sizes))}
    rest = share * sum(sizes.values())
    out: dict = {}
    free = list(weight)
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > epochs * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(epochs * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def plan_mix(
    docs: DataFrame, sources: Column, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS,
    seed: int = 20, most_patterns: int = 100_000,
) -> tuple[Mix, DataFrame]:
    """The decisions of a mix, and the sized rows ``doc_id, pattern, size, place``.

    ``sources`` is an array: the sources a row belongs to.  There must be at most
    ``most_patterns`` patterns; they are what the driver sees of the table.
    """
    sized = docs.select("doc_id", pattern_of(sources).alias("pattern"), word_count(text_of()).alias("size"))
    sized = written(sized.withColumn("place", order_of(seed, F.col("doc_id"), F.col("size"))), "mix-sized")
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    sizes = {tuple(json.loads(r["pattern"])): r["size"] for r in sorted(rows, key=lambda r: r["pattern"])}
    names = {tuple(json.loads(r["pattern"])): r["pattern"] for r in rows}
    own = {s: 0 for p in sizes for s in p}
    for pattern, size in sizes.items():
        for s in pattern:
            own[s] += size
    goal = targets(own, share, epochs, weights)
    words = route({s: round(goal[s]) for s in goal}, sizes, epochs)
    whole = {p: divmod(words[p], sizes[p]) if sizes[p] else (0, 0) for p in sizes}
    limits = _limits(sized, {names[p]: rest for p, (_, rest) in whole.items() if rest}, most_patterns)
    picks = [(names[p], times, *limits.get(names[p], (None, None, None))) for p, (times, _) in whole.items()]
    return Mix(seed, picks, {s: (own[s], goal[s]) for s in own}, names, most_patterns), sized


def _limits(sized: DataFrame, rests: dict[str, int], most: int) -> dict[str, tuple]:
    """For each pattern the place up to which its rows hold at most ``rest`` words, and one more row

    whose size comes nearest to what is then missing: ``(place, size, place of the row)``.
    Places are summed in 65,536 bins first, so only one bin of a pattern is sorted.
    """
    if not rests:
        return {}
    spark = sized.sparkSession
    bin_of = F.shiftright("place", 48)
    wanted = bounded_rows(spark, rests.items(), "pattern string, rest bigint", most)
    bins = sized.groupBy("pattern", bin_of.alias("bin")).agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("pattern").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("words").over(up_to)).join(wanted, "pattern")
    edges = bins.where("upto > rest and upto - words <= rest").groupBy("pattern").agg(
        F.min("bin").alias("bin"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")
    )
    edge_rows = [(r["pattern"], rests[r["pattern"]], r["bin"], r["before"]) for r in edges.collect()]
    at = bounded_rows(spark, edge_rows, "pattern string, rest bigint, edge bigint, before bigint", most)
    inside = sized.join(at, "pattern").where(bin_of == F.col("edge"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("place"))  # equal places count together
    inside = inside.withColumn("upto", F.col("before") + upto).where("upto <= rest")
    inner = {
        r["pattern"]: (r["place"], r["upto"])
        for r in inside.groupBy("pattern").agg(F.max("place").alias("place"), F.max("upto").alias("upto")).collect()
    }
    cut, missing = {}, {}
    for pattern, rest, edge, before in edge_rows:
        cut[pattern], got = inner.get(pattern, ((edge << 48) - 1 if edge > -(2**15) else None, before))
        missing[pattern] = rest - got
    left = bounded_rows(spark, [(p, cut[p], m) for p, m in missing.items() if m], "pattern string, cut bigint, missing bigint", most)
    spare = sized.join(left, "pattern").where("cut is null or place > cut")
    near = spare.groupBy("pattern").agg(
        F.max(F.when(F.col("size") <= F.col("missing"), F.col("size"))).alias("under"),
        F.min(F.when(F.col("size") >= F.col("missing"), F.col("size"))).alias("over"),
    )
    fill = []
    for r in near.collect():
        lacking = missing[r["pattern"]]
        best = min([s for s in (r["under"], r["over"], 0) if s is not None], key=lambda s: (abs(s - lacking), s))
        if best:
            fill.append((r["pattern"], cut[r["pattern"]], best))
    chosen = bounded_rows(spark, fill, "pattern string, cut bigint, best bigint", most)
    one = sized.join(chosen, "pattern").where("(cut is null or place > cut) and size = best")
    extra = {r["pattern"]: (r["best"], r["place"]) for r in one.groupBy("pattern", "best").agg(F.min("place").alias("place")).collect()}
    return {p: (cut[p], *extra.get(p, (None, None))) for p in cut}


def times_taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with ``pattern``, ``size``, ``place``) and how often the mix reads each: ``times``."""
    picks = bounded_rows(
        rows.sparkSession, mix.picks, "pattern string, whole int, upto bigint, one_size bigint, one_place bigint", mix.most_patterns
    )
    more = F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)) | F.coalesce(
        (F.col("place") == F.col("one_place")) & (F.col("size") == F.col("one_size")), F.lit(False)
    )
    return rows.join(picks, "pattern", "left").withColumn(
        "times", F.coalesce("whole", F.lit(0)) + more.cast("int")
    ).drop("whole", "upto", "one_size", "one_place")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row, each in the source it names.

    A null source is a source; a null text has no words and is taken zero words;
    an empty table gives an empty one; rows that repeat id and size are taken
    alike.
    """
    mix, sized = plan_mix(docs.select("doc_id", "text", "source"), F.array("source"), **options)
    by_source = [(mix.names[(s,)], s, n, goal) for s, (n, goal) in mix.sources.items()]
    known = bounded_rows(
        docs.sparkSession, by_source, "pattern string, source string, source_size bigint, target double", mix.most_patterns
    )
    rows = times_taken(sized, mix).join(known, "pattern")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a row read twice is there twice."""
    mix, _ = plan_mix(docs.select("doc_id", "text", "source"), F.array("source"), **options)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.array("source").alias("member"))
    whole = whole.select("row", "doc_id", pattern_of(F.col("member")).alias("pattern"), word_count(text_of()).alias("size"))
    whole = whole.withColumn("place", order_of(mix.seed, F.col("doc_id"), F.col("size")))
    read = times_taken(whole, mix).where("times > 0")
    return read.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")

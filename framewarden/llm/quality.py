"""Quality rules with risk-controlled thresholds, in column functions only.

Fixed rules reject what is plainly broken.  Further rules compare a measure with
a cutoff.  The cutoffs of all rules get stricter together, step by step; of each
stratum the last step is taken up to which labelled rows prove, by an exact
binomial bound, that at most a given share of good documents is rejected by any
rule.  Steps are tested in order and the first failure ends them, so a stratum
needs no correction of its own; the level is divided by the number of strata, and
strata that pass every step hand theirs on to the others.  Strata too small to
prove anything by themselves are pooled and share a bound for all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, text_of, words_of, written
from .pii import let

# Fixed values of the base rules.
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` exceeds a cutoff; cutoffs from the loosest to the strictest."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", tuple(x / 100 for x in (50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1))),
    Rule("duplicate lines", "n_dup_lines / greatest(n_lines, 1)", tuple(x / 100 for x in (95, 90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10, 5))),
    Rule("repeated words", "n_repeat_words / greatest(n_words, 1)", tuple(x / 100 for x in (50, 45, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5))),
    Rule("long words", "word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
)


def repeated_windows(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more.

    Windows are compared by a 64-bit hash.  They are sorted once; equal
    neighbours are repeats, and the words of repeats are counted once each.
    """

    def count(words: Column) -> Column:
        n = F.size(words) - (width - 1)
        shifted = [F.slice(words, F.lit(i + 1), F.greatest(n, F.lit(0))) for i in range(width)]

        def repeats(hashes: Column) -> Column:
            placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

            def words_in(s: Column) -> Column:
                same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
                marked = F.transform(
                    s, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["at"])
                )
                places = F.filter(marked, lambda at: at.isNotNull())
                return F.size(F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(*[at + i for i in range(width)])))))

            return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, words_in)).otherwise(0)

        hashed = F.transform(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]), lambda z: F.xxhash64(z))
        return F.when(n >= 2, let(hashed, repeats)).otherwise(0)

    return let(words, count)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum``, a hash of the text and the counts of every whole text."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARACTERS, "")) > 0)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text_of().alias("text"))
    return rows.select(
        "doc_id", "stratum", F.xxhash64("text").alias("mark"),
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_windows(w).alias("repeats"))).alias("w"),
        F.length(F.translate(text, SPACE_CHARACTERS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("l"),
    ).select(
        "doc_id", "stratum", "mark", F.col("w.n").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.again").cast("bigint").alias("n_dup_lines"), F.col("w.repeats").cast("bigint").alias("n_repeat_words"),
        F.col("l.n").cast("bigint").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, exactly up to rounding: sums the smaller tail outwards from ``k``."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k < n * p:
        term = total = math.exp(log(k))
        for i in range(k, 0, -1):
            term *= i * (1 - p) / ((n - i + 1) * p)
            total += term
            if term < total * 1e-17:
                break
        return min(1.0, total)
    term = total = math.exp(log(k + 1))
    for i in range(k + 1, n):
        term *= (n - i) * p / ((i + 1) * (1 - p))
        total += term
        if term < total * 1e-17:
            break
    return max(0.0, 1 - total)


def most_failures(n: int, share: float, level: float) -> int:
    """The most rejections among ``n`` rows that prove the share at the level; -1 if none do."""
    low, high = -1, int(n * share)
    while low < high:
        middle = (low + high + 1) // 2
        if binomial_cdf(middle, n, share) <= level:
            low = middle
        else:
            high = middle - 1
    return low


def steps_of(rules: tuple[Rule, ...]) -> list[tuple[float, ...]]:
    """Vectors of cutoffs from the loosest to the strictest; shorter lists stay longer at a cutoff."""
    n = max(len(r.cutoffs) for r in rules)
    at = lambda r, j: round(j * (len(r.cutoffs) - 1) / max(1, n - 1))
    return [tuple(r.cutoffs[at(r, j)] for r in rules) for j in range(n)]


def rounded_down(n: Column) -> Column:
    """Three leading digits, so that bounds are computed for few numbers; fewer rows prove no more."""
    unit = F.pow(F.lit(10), F.greatest(F.length(n.cast("string")) - 3, F.lit(0))).cast("bigint")
    return (n - n % unit).cast("bigint")


def chosen_cutoffs(
    measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, most_rejected: float = 0.02, level: float = 0.05,
) -> DataFrame:
    """``stratum, cutoffs``: an array with a cutoff for each rule, for strata with labelled rows; null where nothing is proven.

    Good are rows labelled 1 that pass the base rules, each text once however
    often it is there.  Tables of any number of strata stay tables; the driver
    sees the bounds for numbers of three leading digits.
    """
    spark = measured.sparkSession
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    known = measured.where(~base_failed()).join(good, F.col("doc_id") == F.col("_good"), "left_semi").dropDuplicates(["stratum", "mark"])
    steps = steps_of(rules)
    fails = lambda cut: reduce(Column.__or__, [F.expr(r.measure) > c for r, c in zip(rules, cut, strict=True)])
    found = [F.sum(fails(cut).cast("bigint")).alias(f"k{j}") for j, cut in enumerate(steps)]
    counts = written(known.groupBy("stratum").agg(F.count("*").alias("n"), *found), "quality-counts")
    # The least number of rows that can prove the share without a rejection.
    strata = counts.count()
    least = math.ceil(math.log(level / max(1, strata)) / math.log1p(-most_rejected))
    group = F.when(F.col("n") >= least, F.col("stratum"))
    pools = counts.groupBy(group.alias("pool")).agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).withColumn("size", rounded_down(F.col("n")))
    pools = written(pools, "quality-pools")
    m = pools.count()

    def passed(share_of_level: float) -> DataFrame:
        bounds = [(r["size"], most_failures(r["size"], most_rejected, share_of_level)) for r in pools.select("size").distinct().collect()]
        joined = pools.join(bounded_rows(spark, bounds, "_size bigint, _most bigint", 100_000), F.col("size") == F.col("_size"))
        broken = F.array_position(F.array(*[F.col(f"k{j}") > F.col("_most") for j in range(len(steps))]), True)
        return joined.select("pool", F.when(broken > 0, broken - 1).otherwise(len(steps)).cast("int").alias("passed"))

    taken = passed(level / max(1, m))
    finished = taken.where(F.col("passed") == len(steps)).count()
    if 0 < finished < m:
        taken = passed(level / (m - finished))
    vectors = F.array(*[F.array(*[F.lit(float(c)) for c in cut]) for cut in steps])
    cutoffs = taken.select(F.col("pool").alias("_pool"), F.when(F.col("passed") > 0, F.get(vectors, F.col("passed") - 1)).alias("cutoffs"))
    return counts.withColumn("pool", group).join(cutoffs, F.col("pool").eqNullSafe(F.col("_pool")), "left").select("stratum", "cutoffs")


def quality(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, **risk) -> DataFrame:
    """One row per input row: ``doc_id``, its counts, ``base_failed`` and ``kept``.

    Strata are languages, null as one; a stratum without labelled rows has no
    cutoffs.  Null is a text without words; an empty table gives an empty one.
    """
    measured = written(measures(docs), "quality-measures")
    cutoffs = chosen_cutoffs(measured, labels, rules, **risk).select(F.col("stratum").alias("_stratum"), "cutoffs")
    rows = measured.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left")
    fails = F.lit(False)
    for i, rule in enumerate(rules):
        fails = fails | F.coalesce(F.expr(rule.measure) > F.get("cutoffs", F.lit(i)), F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & ~fails).alias("kept"),
    )

"""Document fingerprints: a homomorphic multiset hash, in column functions only.

A text is the multiset of its paragraphs (lines with a character).  Each
paragraph is hashed to a wide vector and a fingerprint is the sum of the vectors,
lane by lane modulo a power of two, so it does not depend on the order of
paragraphs, and a paragraph is added or taken away by adding or subtracting its
vector.  The vector has two parts: ``EXACT`` lanes of 32 random bits, which tell
equal multisets from others, and ``SIGNS`` lanes of 16 bits with the sums of the
signs of the pairs of neighbouring words, whose cosine estimates how alike two
texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, text_of, words_of, written
from .pii import let

EXACT = 16
SIGNS = 128
#: Two lanes travel in one number while they are summed.
PACKS = SIGNS // 2
FIELD = 0x0000000100000001
NO_ID = -(2**63)


def pieces(text: Column) -> Column:
    """The units of a text: ``struct(first, a, b)`` for each paragraph and each pair of words in it.

    The two hashes are those of the paragraph, where ``first``, or of the pair.
    """
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(p) > 0)

    def unit(first: bool, *parts: Column) -> Column:
        return F.struct(F.lit(first).alias("first"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))

    def units(paragraph: Column) -> Column:
        pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: unit(False, x, F.coalesce(y, F.lit(""))))
        return F.concat(F.array(unit(True, paragraph)), let(words_of(paragraph), pairs))

    return F.flatten(F.transform(paragraphs, units))


def lane(j: int) -> Column:
    """Lane ``j`` of a paragraph: 32 bits of a hash of its two hashes."""
    return F.xxhash64("u.a", "u.b", F.lit(j)).bitwiseAND(0xFFFFFFFF)


def pack(i: int) -> Column:
    """Bits ``i`` and ``i + 32`` of a hash of a pair, one in each half."""
    return F.shiftrightunsigned("u.a" if i < 32 else "u.b", i % 32).bitwiseAND(FIELD)


def hashed(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key``, ``times`` and the sums of each key's units, summed in every task before the shuffle.

    Rows of equal keys hold equal texts; ``times`` of them are summed, so a sum
    divides by ``times``.
    """
    units = rows.select(*key, F.posexplode_outer(pieces(F.col(text))).alias("at", "u"))
    first = F.coalesce(F.col("u.first"), F.lit(True))
    pair = ~first
    summed = units.groupBy(*key).agg(
        F.sum((F.coalesce("at", F.lit(0)) == 0).cast("long")).alias("times"), F.sum(pair.cast("long")).alias("pairs"),
        *[F.sum(F.when(first & F.col("u.a").isNotNull(), lane(j)).otherwise(0)).alias(f"e{j}") for j in range(EXACT)],
        *[F.sum(F.when(pair, pack(i)).otherwise(0)).alias(f"s{i}") for i in range(PACKS)],
    )
    # Sums divide by ``times`` without a rest; the arrays keep the generated code short.
    once = lambda x: (x / F.col("times")).cast("bigint")
    wrapped = lambda x, bits: (x + 2 ** (bits - 1)).bitwiseAND(2**bits - 1) - 2 ** (bits - 1)
    sign = lambda x: wrapped(2 * once(x) - once(F.col("pairs")), 16).cast("short")
    halves = [F.transform("s", lambda x: sign(x.bitwiseAND(0xFFFFFFFF))), F.transform("s", lambda x: sign(F.shiftrightunsigned(x, 32)))]
    return summed.select(
        *key, "times", "pairs", F.array(*[F.col(f"e{j}") for j in range(EXACT)]).alias("e"),
        F.array(*[F.col(f"s{i}") for i in range(PACKS)]).alias("s"),
    ).select(
        *key, "times", F.transform("e", lambda x: wrapped(once(x), 32).cast("int")).alias("exact"), F.concat(*halves).alias("signs")
    )


def spelled(exact: Column, signs: Column) -> Column:
    """A fingerprint in hex digits: exact lanes modulo 2**32, then sign lanes modulo 2**16."""
    wide = F.transform(exact, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    low = F.transform(signs, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(0xFFFF)), 4, "0"))
    return F.lower(F.concat_ws("", F.concat(wide, low)))


def likeness(a: str, b: str) -> Column:
    """Cosine of the sign lanes of fingerprints ``a`` and ``b``, from 0 to 1; 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col(f"{a}_signs"), F.col(f"{b}_signs")
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(0.0)
    same = (F.col(f"{a}_exact") == F.col(f"{b}_exact")) & (x == y)
    return F.when(same, 1.0).otherwise(cosine)


def chunked(rows: DataFrame, rows_a_chunk: int = 4000, intervals: int = 256, parts: int = 256) -> DataFrame:
    """``rows`` with ``chunk``, a number that rises with ``id`` and splits the rows about evenly.

    At most ``intervals * parts`` chunks: quantiles of the ids, each cut into parts of equal width.
    """
    n, low, high = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    wanted = max(1, n // rows_a_chunk)
    cuts = min(intervals, wanted)
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("id", [i / cuts for i in range(1, cuts)], 0.2 / cuts)}) if cuts > 1 else []
    part = min(parts, -(-wanted // cuts))
    edges = F.array(*[F.lit(x).cast("bigint") for x in [low or 0, *bounds, high or 0]])

    def place(e: Column) -> Column:
        at = F.size(F.filter(F.slice(e, 2, len(bounds)), lambda x: x < F.col("id"))) if bounds else F.lit(0)
        start, stop = F.element_at(e, at + 1).cast("double"), F.element_at(e, at + 2).cast("double")
        within = (F.col("id").cast("double") - start) / F.greatest(stop - start, F.lit(1.0))
        return at.cast("bigint") * parts + F.least(F.floor(within * part), F.lit(part - 1))

    return rows.withColumn("chunk", place(edges))


def with_next(rows: DataFrame, columns: tuple[str, ...] = ("id", "mark", "text")) -> DataFrame:
    """Each row with the ``columns``, named ``next_...``, of the row after it by descending ``id``, then ``mark``.

    After the last comes the first.  One shuffle of the rows, by chunk; the first
    rows of the chunks, at most one each, follow the last of others.
    """
    rows = chunked(rows)
    spark = rows.sparkSession
    tops = rows.groupBy("chunk").agg(F.max("id").alias("top")).orderBy(F.desc("chunk")).collect()
    after = {r["chunk"]: tops[(i + 1) % len(tops)]["top"] for i, r in enumerate(tops)}
    heads = bounded_rows(spark, [(c, top) for c, top in after.items()], "before bigint, top bigint", 1 << 16)
    first = rows.join(heads, F.col("id") == F.col("top")).groupBy(F.col("before").alias("chunk")).agg(
        F.min_by(F.struct(*columns), "mark").alias("head")
    )
    order = Window.partitionBy("chunk").orderBy(F.desc("id"), "mark")
    ahead = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    joined = ahead.join(first, "chunk", "left")
    last = F.col("next_id").isNull()
    return joined.withColumns({f"next_{c}": F.when(last, F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop("head", "chunk")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last half replaced by the start of the next row's
    text.  Null is an empty text; a null id comes after all others; rows that
    repeat an id follow each other by a hash of their texts; a single row is its
    own next; an empty table gives an empty one.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("id"), text_of().alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    own = written(hashed(rows, ["id", "mark"], "text").drop("times"), "prints")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edits = with_next(rows).select(
        "id", "mark", "next_id", "next_mark", n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"),
    )
    edits = edits.withColumn("sha", F.sha2("edited", 256))
    changed = hashed(edits, ["id", "mark", "next_id", "next_mark", "n_chars", "sha"], "edited")
    named = lambda df, p: df.withColumnsRenamed({"exact": f"{p}_exact", "signs": f"{p}_signs"})
    # Of equal rows all but the last are followed by their like.
    ahead = named(with_next(own, ("id", "mark", "exact", "signs")), "own").withColumnsRenamed(
        {"next_exact": "after_exact", "next_signs": "after_signs"}
    )
    onward = ahead.select("id", "mark", likeness("own", "after").alias("onward"))
    all_three = named(changed, "edited").join(named(own, "own"), ["id", "mark"]).join(onward, ["id", "mark"])
    like = (F.col("id") == F.col("next_id")) & (F.col("mark") == F.col("next_mark"))
    return all_three.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        spelled(F.col("own_exact"), F.col("own_signs")).alias("fingerprint"),
        spelled(F.col("edited_exact"), F.col("edited_signs")).alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), F.when(like, 1.0).otherwise(F.col("onward")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"),
    ).drop("_copy")

"""Exact duplicates by an index of cuckoo filters.

The index of live digests is split into shards by hash.  A shard has a cuckoo
filter of its digests; the digests themselves, with what is known of their
copies, are stored beside it.  An arriving digest that its filter does not know
is new.  A hit is verified against the content: the digests that arrived in the
same bucket, then the stored ones.  A filter that overflows is built anew, larger,
from the stored digests, and so are all when the shards get too full.  Deleting
documents takes digests without copies out of filters and store.

Arriving copies are summed before they meet in a shard, at most ``SALTS`` rows a
digest, so a group of copies of any size costs its shard as much as a small one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, text_of, written
from .cuckoo import CuckooFilter, buckets_for, built

# Fixed value: the characters that do not count.
DROPPED = " \t\n\x0b\x0c\r"
KEYS_A_SHARD = 8192
SALTS = 16

#: Of the copies of a digest the largest of these stays: most code points, then the smallest id, no id last.
_BEST = "n_chars bigint, flip bigint, flop bigint"
_KEYS = f"shard bigint, digest binary, copies bigint, {_BEST}"
_FILTERS = "shard bigint, buckets int, slots binary, stash array<binary>"
_BOTH = f"{_KEYS}, known boolean, buckets int, slots binary, stash array<binary>"


@dataclass(frozen=True)
class DedupIndex:
    #: ``2**bits`` shards.
    bits: int
    #: Live rows: ``digest, doc_id, n_chars, row``.
    rows: DataFrame
    #: Live digests, their number of copies and the copy that stays.
    keys: DataFrame
    #: One filter a shard that has keys.
    filters: DataFrame
    fingerprint_bits: int = 16


def normalised(text: Column) -> Column:
    return F.translate(text, DROPPED, "")


def rows_of(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, n_chars, row`` of every document, written once; null is an empty text."""
    text = text_of()
    rows = docs.select(
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.xxhash64(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id()).alias("row"),
    )
    return written(rows, "dedup-rows")


def shard_of(bits: int) -> Column:
    return F.xxhash64("digest").bitwiseAND(2**bits - 1)


def summed(rows: DataFrame, bits: int) -> DataFrame:
    """The copies of each digest as at most ``SALTS`` rows."""
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("flip"), F.bitwise_not("row").alias("flop")))
    parts = rows.groupBy("digest", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("copies"), best.alias("best"))
    return parts.select(shard_of(bits).alias("shard"), "digest", "copies", "best.*")


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def rank(entry: dict) -> tuple:
    flip = entry["flip"]
    return entry["n_chars"], flip is not None, flip or 0, entry["flop"]


def merged(into: dict, more: dict) -> None:
    into["copies"] += more["copies"]
    if rank(more) > rank(into):
        into |= {c: more[c] for c in ("n_chars", "flip", "flop")}


def filter_of(row: dict, bits: int) -> CuckooFilter:
    return CuckooFilter(row["buckets"], bits, row["slots"], map(key_of, row["stash"]))


def filter_row(shard: int, index: CuckooFilter, digests: dict[int, bytes]) -> dict:
    return {"shard": shard, "buckets": index.buckets, "slots": index.slots.tobytes(), "stash": [digests[k] for k in index.stash]}


def as_table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def looked_up(parts: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Distinct arriving digests and the changed filters, in one table.

    ``known`` is false for new digests, which are in the filters now, true for
    those to be verified against the store, and null for the rows of filters.
    """
    schema = arrow_schema(parts.sparkSession, _BOTH)

    def shard(key: tuple, arriving: pa.Table, stored: pa.Table) -> pa.Table:
        rows = stored.to_pylist()
        index = filter_of(rows[0], bits) if rows else CuckooFilter(buckets_for(arriving.num_rows // 2), bits)
        content: dict[int, list[dict]] = defaultdict(list)  # by the filter's key
        for row in arriving.to_pylist():
            number = key_of(row["digest"])
            hit = number in index
            like = next((e for e in content[number] if e["digest"] == row["digest"]), None) if hit else None
            if like is not None:
                merged(like, row)
                continue
            # Only a filter with stored digests leaves a doubt.
            content[number].append(row | {"known": hit and bool(rows)})
            if not content[number][-1]["known"]:
                index.add(number)
        found = [e for bucket in content.values() for e in bucket]
        digests = {key_of(e["digest"]): e["digest"] for e in found} | {key_of(d): d for r in rows for d in r["stash"]}
        out = found + ([filter_row(key[0].as_py(), index, digests)] if found or rows else [])
        return as_table(out, schema)

    return parts.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(shard, _BOTH)


def changed_filters(filters: DataFrame, digests: DataFrame, adding: bool, bits: int) -> DataFrame:
    """All filters, those of ``digests`` (``shard, digest``) with these added or taken out."""
    schema = arrow_schema(filters.sparkSession, _FILTERS)

    def shard(key: tuple, listed: pa.Table, stored: pa.Table) -> pa.Table:
        rows = stored.to_pylist()
        if not listed.num_rows:
            return as_table(rows, schema)
        keys = {key_of(d): d for d in listed.column("digest").to_pylist()}
        index = filter_of(rows[0], bits) if rows else CuckooFilter(buckets_for(len(keys)), bits)
        for number in map(key_of, listed.column("digest").to_pylist()):
            (index.add if adding else index.remove)(number)
        names = keys | {key_of(d): d for r in rows for d in r["stash"]}
        return as_table([filter_row(key[0].as_py(), index, names)], schema)

    return digests.select("shard", "digest").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(shard, _FILTERS)


def filters_from(keys: DataFrame, sizes: DataFrame | None, bits: int) -> DataFrame:
    """Filters of stored ``keys``; ``sizes`` (``shard, buckets``) are those that were too small."""
    schema = arrow_schema(keys.sparkSession, _FILTERS)
    narrow = keys.select("shard", "digest")
    narrow = narrow.withColumn("buckets", F.lit(0)) if sizes is None else narrow.join(sizes.select("shard", "buckets"), "shard")

    def shard(key: tuple, stored: pa.Table) -> pa.Table:
        numbers = [key_of(d) for d in stored.column("digest").to_pylist()]
        index = built(numbers, bits, 2 * stored.column("buckets")[0].as_py())
        return as_table([filter_row(key[0].as_py(), index, {})], schema)

    return narrow.groupBy("shard").applyInArrow(shard, _FILTERS)


def resized(index: DedupIndex) -> DedupIndex:
    """Overflowed filters built anew from the stored digests."""
    small = index.filters.where(F.size("stash") > 0)
    if small.isEmpty():
        return index
    larger = filters_from(index.keys, small, index.fingerprint_bits)
    return DedupIndex(
        index.bits, index.rows, index.keys, written(index.filters.where(F.size("stash") == 0).union(larger), "dedup-filters"),
        index.fingerprint_bits,
    )


def reshared(index: DedupIndex, bits: int) -> DedupIndex:
    """The index in ``2**bits`` shards, its filters built from the stored digests."""
    keys = written(index.keys.withColumn("shard", shard_of(bits)), "dedup-keys")
    filters = written(filters_from(keys, None, index.fingerprint_bits), "dedup-filters")
    return DedupIndex(bits, index.rows, keys, filters, index.fingerprint_bits)


def bits_for(keys: int) -> int:
    return max(0, (keys - 1) // KEYS_A_SHARD).bit_length()


def empty_index(spark: SparkSession, expected: int = 0, fingerprint_bits: int = 16) -> DedupIndex:
    """An index without digests, in shards for so many expected ones."""
    rows = spark.createDataFrame([], "digest binary, doc_id bigint, n_chars bigint, row bigint")
    return DedupIndex(bits_for(expected), rows, spark.createDataFrame([], _KEYS), spark.createDataFrame([], _FILTERS), fingerprint_bits)


def insert(index: DedupIndex, rows: DataFrame) -> DedupIndex:
    """The index with the ``rows`` of more documents (as ``rows_of`` gives them)."""
    bits = bits_for(index.keys.count() + rows.count())
    if bits > index.bits + 1:
        index = reshared(index, bits)
    seen = written(looked_up(summed(rows, index.bits), index.filters, index.fingerprint_bits), "dedup-seen")
    columns = ["shard", "digest", "copies", "n_chars", "flip", "flop"]
    new = seen.where("known = false").select(columns)
    filters = seen.where("known is null").select(index.filters.columns)
    hits = seen.where("known").select(columns)
    if hits.isEmpty():
        keys = index.keys.union(new)
    else:
        doubtful = written(hits.join(index.keys.select("digest"), "digest", "left_anti").select(columns), "dedup-doubtful")
        filters = changed_filters(filters, doubtful, True, index.fingerprint_bits)
        more = hits.select("digest", *[F.col(c).alias(f"more_{c}") for c in columns[2:]])
        best = F.greatest(F.struct("n_chars", "flip", "flop"), F.struct(*[F.col(f"more_{c}").alias(c) for c in columns[3:]]))
        kept = index.keys.join(more, "digest", "left").select(
            "shard", "digest", (F.col("copies") + F.coalesce("more_copies", F.lit(0))).alias("copies"),
            F.when(F.col("more_copies").isNull(), F.struct("n_chars", "flip", "flop")).otherwise(best).alias("best"),
        )
        keys = kept.select("shard", "digest", "copies", "best.*").union(new).union(doubtful)
    return resized(DedupIndex(
        index.bits, written(index.rows.union(rows.select(index.rows.columns)), "dedup-live"), written(keys, "dedup-keys"),
        written(filters, "dedup-filters"), index.fingerprint_bits,
    ))


def delete(index: DedupIndex, gone: DataFrame) -> DedupIndex:
    """The index without the documents whose ``doc_id`` is in ``gone``; ids that are not in it change nothing."""
    ids = gone.select("doc_id").where("doc_id is not null").distinct()
    rows = written(index.rows.join(ids, "doc_id", "left_anti").select(index.rows.columns), "dedup-live")
    touched = written(index.rows.join(ids, "doc_id", "left_semi").select("digest").distinct(), "dedup-touched")
    left = summed(rows.join(touched, "digest", "left_semi"), index.bits).groupBy("shard", "digest").agg(
        F.sum("copies").alias("copies"), F.max(F.struct("n_chars", "flip", "flop")).alias("best")
    )
    left = written(left.select("shard", "digest", "copies", "best.*"), "dedup-left")
    keys = written(index.keys.join(touched, "digest", "left_anti").select(left.columns).union(left), "dedup-keys")
    dead = touched.join(left.select("digest"), "digest", "left_anti").withColumn("shard", shard_of(index.bits))
    filters = changed_filters(index.filters, dead, False, index.fingerprint_bits)
    return DedupIndex(index.bits, rows, keys, written(filters, "dedup-filters"), index.fingerprint_bits)


def groups(index: DedupIndex) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every live row."""
    keys = index.keys.select("digest", "copies", F.bitwise_not("flip").alias("keep_id"), F.bitwise_not("flop").alias("keep_row"))
    return index.rows.join(keys, "digest").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of the rows of ``docs`` (``doc_id``, ``text``) whose texts are equal without spaces and line characters.

    Of a group the row with the most code points stays, then that with the
    smallest id; a null id comes after all others; of rows that repeat both one
    stays.  Null is an empty text.  Equal means equal SHA-256 of the normalised
    text.  Texts of any length are read as a whole and never shuffled; an empty
    table gives an empty one; further columns are left out.
    """
    rows = rows_of(docs)
    return groups(insert(empty_index(docs.sparkSession, rows.count()), rows))

"""Merkle manifest of a dataset as a persistent tree, copied along paths.

Leaves are ordered by a range shuffle and dealt out in aligned blocks of
``3**LEVELS``, so each block is a whole subtree that one task builds.  In a block
the base tree is a pool of nodes; every tampered leaf makes a version: its
ancestors in the block are copied and point to the new node on the path and to
the untouched nodes of the base beside it.  The roots of the blocks are the
leaves of the next round, with blocks of their own, until each tree has one
node; versions go on there as rows, each folded with its block's siblings above.
The trees of the sources end in subroots, which are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, written

FAN_OUT = 3
#: Levels of a block.
LEVELS = 7
BLOCK = FAN_OUT**LEVELS
ROWS_A_PART = 32_768
#: Bytes of a digest.
WIDE = 32


def digest_of(*parts: bytes) -> bytes:
    """The digest of digests, which are read as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


@dataclass
class Pool:
    """Nodes of persistent trees: a digest and the numbers of the children, none for leaves."""

    digests: list[bytes] = field(default_factory=list)
    children: list[tuple[int, ...]] = field(default_factory=list)

    def node(self, digest: bytes, children: tuple[int, ...] = ()) -> int:
        self.digests.append(digest)
        self.children.append(children)
        return len(self.digests) - 1

    def parent(self, children: tuple[int, ...]) -> int:
        return self.node(digest_of(*(self.digests[c] for c in children)), children)

    def tree(self, leaves: list[bytes], levels: int | None) -> list[list[int]]:
        """Nodes of the base tree level by level: so many levels, or as many as lead to one node."""
        rows = [[self.node(x) for x in leaves]]
        while (len(rows[-1]) > 1) if levels is None else (len(rows) <= levels):
            last = rows[-1]
            rows.append([self.parent(tuple(last[i : i + FAN_OUT])) for i in range(0, len(last), FAN_OUT)])
        return rows

    def version(self, rows: list[list[int]], at: int, leaf: bytes) -> list[int]:
        """The copied nodes of a version whose leaf ``at`` is another one, from the leaf up."""
        copies = [self.node(leaf)]
        for row in rows[1:]:
            slot, at = at % FAN_OUT, at // FAN_OUT
            old = self.children[row[at]]
            copies.append(self.parent((*old[:slot], copies[-1], *old[slot + 1 :])))
        return copies

    def siblings(self, rows: list[list[int]], at: int) -> list[tuple[bytes, bytes]]:
        """The digests left and right of the path from leaf ``at``, a pair a level."""
        out = []
        for row in rows[:-1]:
            first = at - at % FAN_OUT
            pick = lambda a, b, row=row: b"".join(self.digests[n] for n in row[a:b])
            out.append((pick(first, at), pick(at + 1, first + FAN_OUT)))
            at //= FAN_OUT
        return out


# Columns -----------------------------------------------------------------

_PATH = "array<struct<left:binary,right:binary>>"


def spelled(digests: Column) -> Column:
    """Hex text of one digest or of several in a row."""
    return F.lower(F.hex(digests))


def parent_of(left: Column, digest: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(spelled(left), spelled(digest), spelled(right)), 256))


def folded(digest: Column, path: Column) -> Column:
    """The node that a path of siblings leads to."""
    return F.aggregate(path, digest, lambda node, s: parent_of(s["left"], node, s["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(spelled(s["left"]), spelled(s["right"]))))


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256))


# Order -------------------------------------------------------------------


def ordered(rows: DataFrame) -> DataFrame:
    """``tree, pos, id, leaf, other``: the leaves of each tree numbered by ``id`` (null last), then by digest.

    ``rows`` have ``tree`` (a string, or null), ``id, leaf, other``.  Equal rows
    travel as one with their number, so the range shuffle has no hot key: one
    pass numbers the rows of its part, and small sums over the parts do the rest.
    """
    runs = rows.groupBy("tree", "id", "leaf", "other").agg(F.count("*").alias("times"))
    runs = written(runs, "merkle-runs")
    n = runs.count()
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_PART, 1)
    order = ["tree", F.col("id").isNull(), "id", "leaf", "other"]
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.LongType()), T.StructField("before", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            before = []
            for name, times in zip(batch.column("tree").to_pylist(), batch.column("times").to_pylist(), strict=True):
                tree, count = (tree, count) if name == tree else (name, 0)
                before.append(count)
                count += times
            more = [pa.array([part] * len(before), pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "before"])

    placed = written(dealt.mapInArrow(numbered, schema), "merkle-placed")
    sums = placed.groupBy("tree", "part").agg(F.sum("times").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("tree").alias("s_tree"), F.col("part").alias("s_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("from"))
    joined = placed.join(sums, placed["tree"].eqNullSafe(sums["s_tree"]) & (placed["part"] == sums["s_part"]))
    at = F.col("from") + F.col("before")
    return joined.select("tree", F.explode(F.sequence(at, at + F.col("times") - 1)).alias("pos"), "id", "leaf", "other")


# Rounds ------------------------------------------------------------------


def as_digests(items: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in items]


def built_blocks(leaves: DataFrame) -> DataFrame:
    """One round over ``leaves`` (``tree, pos, n, id, leaf, other``), ``n`` leaves a tree.

    Each leaf with ``block``, the ``top`` of its block, its ``path`` of siblings
    there and the digests of the nodes its version copies (``copies``, none
    without ``other``).  The only block of a tree ends in one node.
    """
    ddl = f"tree string, block bigint, pos bigint, id bigint, leaf binary, top binary, path {_PATH}, copies array<binary>"
    schema = arrow_schema(leaves.sparkSession, ddl)

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        listed = sorted(rows.to_pylist(), key=lambda r: r["pos"])
        pool = Pool()
        tree = pool.tree([r["leaf"] for r in listed], None if listed[0]["n"] <= BLOCK else LEVELS)
        top = pool.digests[tree[-1][0]]
        out = []
        for at, r in enumerate(listed):
            copies = None if r["other"] is None else [pool.digests[c] for c in pool.version(tree, at, r["other"])]
            out.append({
                "tree": r["tree"], "block": r["pos"] // BLOCK, "pos": r["pos"], "id": r["id"], "leaf": r["leaf"], "top": top,
                "path": as_digests(pool.siblings(tree, at)), "copies": copies,
            })
        return pa.Table.from_pylist(out, schema)

    blocks = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return blocks.groupBy("tree", "block").applyInArrow(block, ddl)


def rounds(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lowest, above, tops)`` of trees of ``leaves`` (``tree, pos, id, leaf, other``).

    ``lowest`` is the first round, as ``built_blocks`` gives it; ``above`` has
    ``tree, block, path``, the siblings above each of its blocks up to the
    tree's root; ``tops`` has ``tree, root``.
    """
    sizes = leaves.groupBy("tree").agg((F.max("pos") + 1).alias("n")).select(F.col("tree").alias("s_tree"), "n")
    current = leaves.join(sizes, F.col("tree").eqNullSafe(F.col("s_tree"))).drop("s_tree")
    done = [written(built_blocks(current), f"{name}-round")]
    while True:
        tops = done[-1].groupBy("tree", "block").agg(F.min("top").alias("leaf"))
        sizes = tops.groupBy("tree").agg(F.count("*").alias("n"))
        if sizes.where("n > 1").isEmpty():
            break
        sizes = sizes.select(F.col("tree").alias("s_tree"), "n")
        next_leaves = tops.join(sizes, F.col("tree").eqNullSafe(F.col("s_tree"))).select(
            "tree", F.col("block").alias("pos"), "n", F.lit(None).cast("bigint").alias("id"), "leaf", F.lit(None).cast("binary").alias("other")
        )
        done.append(written(built_blocks(next_leaves), f"{name}-round"))
    # From the last round down: the path above a block goes on in the round above.
    top = done[-1]
    above = top.select("tree", "block").distinct().withColumn("path", F.array().cast(_PATH))
    for upper in reversed(done[1:]):
        above = written(on_block(upper, above).select("tree", F.col("pos").alias("block"), F.concat("path", "up").alias("path")), f"{name}-above")
    return done[0], above, top.groupBy("tree").agg(F.min("top").alias("root"))


def on_block(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Rows with ``up``, the path above their block."""
    up = above.select(F.col("tree").alias("u_tree"), F.col("block").alias("u_block"), F.col("path").alias("up"))
    return rows.join(up, F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("block") == F.col("u_block"))).drop("u_tree", "u_block")


def merkle_versions(docs: DataFrame, other: Column) -> DataFrame:
    """Leaves, proofs and versions of ``docs``: ``id, tree, leaf, subroot, root, path, version``.

    ``other`` is the digest of a row's tampered leaf, null where it is as it
    was.  ``path`` holds the siblings from the leaf to the root, ``version`` the
    digest of the root of the row's version: of its copied nodes within the
    block, continued by the siblings of the blocks above.
    """
    leaves = ordered(docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("bigint").alias("id"), leaf_of().alias("leaf"), other.alias("other")
    ))
    lowest, above, subroots = rounds(leaves, "merkle-sources")
    # The subroots, numbered by source; null comes first in Spark's order, others by bytes.
    sources = written(subroots, "merkle-subroots")
    place = ordered_sources(sources)
    top_leaves = place.select(
        F.lit("").alias("tree"), "pos", F.lit(None).cast("bigint").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("other")
    )
    top_round, top_above, tops = rounds(top_leaves, "merkle-top")
    ups = on_block(top_round, top_above).select(F.col("pos").alias("t_pos"), F.concat("path", "up").alias("top_path"))
    found = tops.select("root").collect()
    root = F.lit(found[0]["root"] if found else None).cast("binary")
    over = place.join(ups, F.col("pos") == F.col("t_pos")).select(F.col("tree").alias("o_tree"), F.col("root").alias("subroot"), "top_path")
    blocks = above.join(over, F.col("tree").eqNullSafe(F.col("o_tree"))).select(
        "tree", "block", F.concat("path", "top_path").alias("path"), "subroot"
    )
    blocks = written(blocks, "merkle-blocks")
    up = blocks.select(F.col("tree").alias("u_tree"), F.col("block").alias("u_block"), F.col("path").alias("up"), "subroot")
    rows = lowest.join(up, F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("block") == F.col("u_block")))
    # An untouched row's version is the base itself: its own path, folded.
    start = F.when(F.col("copies").isNull(), folded(F.col("leaf"), F.col("path"))).otherwise(F.element_at("copies", -1))
    return rows.select(
        "id", "tree", "leaf", "subroot", root.alias("root"), F.concat("path", "up").alias("path"), folded(start, F.col("up")).alias("version")
    )


def ordered_sources(subroots: DataFrame) -> DataFrame:
    """``tree, root, pos``: the subroots numbered by source, null first."""
    rows = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_A_PART, 1)
    dealt = written(
        rows.repartitionByRange(parts, F.col("name").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "merkle-names"
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(F.col("part").alias("s_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("from"))
    within = Window.partitionBy("part").orderBy(F.col("name").asc_nulls_first())
    return dealt.withColumn("k", F.row_number().over(within) - 1).join(sums, F.col("part") == F.col("s_part")).select(
        F.col("name").alias("tree"), "root", (F.col("from") + F.col("k")).alias("pos")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows whose id has an even CRC-32 are tampered with: their text loses its
    line ends.  Nulls are fields of their own; a row without an id comes last in
    its source and is not tampered with; rows that repeat an id follow each other
    by their leaves, equal rows are leaves each.  Texts of any length are hashed
    as a whole and never shuffled.  A single row is its own root with an empty
    proof; an empty table gives an empty one; further columns are left out.
    """
    rows = docs.select(*FIELDS)
    spared = leaf_of(text=F.translate("text", "\n", ""))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    versions = merkle_versions(rows, F.when(even, spared))
    return versions.select(
        F.col("id").alias("doc_id"), *[spelled(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), spelled(F.col("version")).alias("folded_root"),
        (F.col("version") == F.col("root")).alias("verified"),
    )

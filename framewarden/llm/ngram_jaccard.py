"""N-gram Jaccard join by set relations.

Sets are indexed by a prefix of their members in one global order: any two sets
as similar as asked share a member of their prefixes.  An index list is first
answered for one set only, its leader.  The leader's exact distances to all
sets of the list then answer most other questions, since the Jaccard distance
is a metric: two sets both close to the leader are in one class already, and
two whose distances to it differ by more than the limit cannot be linked.  Pairs
that are left open meet in a join on the member; size, position and the known
distances are tested there, once a pair is formed, not before.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written
from .components import components
from .shingles import set_hash, sets_of

NO_ID = -(2**63)
STAR_ROWS = 256
#: Up to so many questions, of less than 100 bytes each, are broadcast to the texts instead of dealing these out.
BROADCAST_ROWS = 100_000
#: Lists from this length on are answered for further leaders, so many a round.
LONG_LIST, LEADERS, ROUNDS = 32, 5, 2


def prefix_length(n: int, percent: int) -> int:
    """Members to index of a set of ``n``: any partner shares one of them."""
    return n - math.ceil(n * percent / 100) + 1


def frequent_members(keyed: DataFrame, sample_docs: int, most: int) -> np.ndarray:
    """Hashes of members that recur in a sample of about ``sample_docs`` documents, rarest first.

    They only decide the order of members, which shortens the lists; results do
    not depend on them.
    """
    n = keyed.count()
    share = max(1, n // sample_docs)
    picked = keyed.where(F.pmod(F.xxhash64(F.lit("order"), "key"), F.lit(share)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in sets_of(batch.column(0)):
                members, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(times)], ["h", "n"])

    top = (
        picked.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
        .where("n >= 2").orderBy(F.desc("n"), "h").limit(most)
    )
    found = top.toArrow()
    members, times = found["h"].to_numpy(), found["n"].to_numpy()
    return members[np.lexsort((members, times))].astype(np.int64).view(np.uint64)


def indexed(keyed: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """``key, mark, n, set_id, prefix`` of every document."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in sets_of(batch.column(2)):
                sizes, names, heads = [], [], []
                for s in sets:
                    sizes.append(len(s))
                    names.append(set_hash(s))
                    if not len(s):
                        heads.append(s)
                        continue
                    want = prefix_length(len(s), percent)
                    if len(known):
                        where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[where] == s
                        head = s[~often][:want]
                        if len(head) < want:
                            rank = np.sort(by_hash[where[often]])
                            head = np.concatenate([head, frequent[rank[: want - len(head)]]])
                    else:
                        head = s[:want]
                    heads.append(head)
                bounds = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(h) for h in heads], out=bounds[1:])
                flat = np.concatenate(heads).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        batch.column(1).slice(at, len(sets)),
                        pa.array(sizes, pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                    ],
                    ["key", "mark", "n", "set_id", "prefix"],
                )

    return keyed.mapInArrow(run, "key bigint, mark bigint, n bigint, set_id bigint, prefix array<bigint>")


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``a, b, na, nb, common`` of the pairs ``a, b`` of sets, counted on the whole texts.

    A set's partners are read in portions, its own text once for each.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("portions"))
    portion = F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion")
    heads = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.col("a").alias("set_id"), F.lit(0).alias("turn"))
    rest = pairs.join(fan, "a").select("a", portion, F.col("b").alias("set_id"), F.lit(1).alias("turn"))
    asked = written(heads.union(rest).join(nodes.select("set_id", "rep.key", "rep.mark"), "set_id"), "jaccard-questions")
    wanted = keyed.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, ["key", "mark"])
    wanted = wanted.select("a", "portion", "turn", "set_id", "text").repartition("a", "portion")
    wanted = wanted.sortWithinPartitions("a", "portion", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, portion, turn, name = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for at, sets in sets_of(batch.column(4)):
                for i, s in enumerate(sets, at):
                    if set_hash(s) != name[i]:
                        continue  # another text under the same id
                    if turn[i] == 0:
                        now, own = (a[i], portion[i]), s
                    elif now == (a[i], portion[i]):
                        few, many = (s, own) if len(s) < len(own) else (own, s)
                        where = np.minimum(np.searchsorted(many, few), len(many) - 1)
                        out.append((a[i], name[i], len(own), len(s), int((many[where] == few).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "na", "nb", "common"])

    return wanted.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, common bigint").distinct()


def similar_sizes(one: Column, other: Column, percent: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def enough_shared(one: Column, other: Column, percent: int) -> Column:
    """Whether ``shared`` members of both prefixes leave room for a link.

    Of the two prefixes one ends first; what its set has in common with the
    other set lies in both prefixes or after its own end.
    """
    after = F.ceil(F.greatest(one, other) * percent / 100) - 1
    return (F.col("shared") + after) * (100 + percent) >= (one + other) * percent


def overlap_of(one: Column, other: Column, percent: int) -> Column:
    """The least number of common members of linked sets."""
    return F.ceil((one + other) * percent / (100 + percent))


def first_shared(one: Column, other: Column, percent: int) -> Column:
    """How many first common members to look for.

    The ``k``-th common member of linked sets has at least ``overlap - k`` of
    either set behind it, so each of the first ``k`` stands no later than
    ``last_place``.  A larger ``k`` looks further into the lists and drops more
    pairs; both prefixes reach far enough for any up to ``room + 1``.  Small sets
    seldom meet by chance, so one is enough for them.
    """
    room = overlap_of(one, other, percent) - F.ceil(F.greatest(one, other) * percent / 100)
    return F.when(room > 20, F.floor(room * 0.25)).otherwise(0) + 1


def last_place(x: str, y: str, percent: int) -> Column:
    """The last position in ``x`` of the common members counted."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return n - overlap_of(n, m, percent) + first_shared(n, m, percent) - 1


def reachable_overlap(x: str, y: str, percent: int) -> Column:
    """Whether lists positions leave room for enough common members: none before the nearer

    position is missed, and no more can follow than the shorter rest holds.
    """
    most = F.least(f"{x}.pos", f"{y}.pos") + 1 + F.least(
        F.col(f"{x}.n") - F.col(f"{x}.pos") - 1, F.col(f"{y}.n") - F.col(f"{y}.pos") - 1
    )
    return most * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent


def more_leaders(long: DataFrame, classes: DataFrame, asked: DataFrame, turn: int, percent: int) -> DataFrame:
    """New questions ``a, b`` (``a`` < ``b``) on lists whose sets are in several classes.

    Each list draws up to ``LEADERS`` sets and asks about its sets of other
    classes than theirs: as many questions as rows, whatever the length.  The
    first turn draws those that are in most long lists, as the text is that
    others were edited from; later turns draw by hash.
    """
    rows = long.join(classes, long.set_id == classes.node, "left").select(
        "member", "set_id", "n", "lists", F.coalesce("component", "set_id").alias("class")
    )
    several = rows.groupBy("member").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    rows = written(rows.join(several.select("member"), "member"), "jaccard-open")
    draw = F.xxhash64(F.lit(turn), "set_id")
    part = F.pmod(draw, F.lit(LEADERS)).alias("part")
    if turn == 0:
        draw = F.pmod(draw, F.lit(2**31)) - F.col("lists") * 2**31
    heads = rows.groupBy("member", part).agg(
        F.min_by("set_id", draw).alias("head"), F.min_by("class", draw).alias("head_class"), F.min_by("n", draw).alias("head_n")
    )
    pairs = rows.join(heads, "member").where("class <> head_class").where(similar_sizes(F.col("n"), F.col("head_n"), percent))
    pairs = pairs.select(
        F.least("set_id", "head").alias("a"), F.greatest("set_id", "head").alias("b"), F.col("n").alias("one"), F.col("head_n").alias("other")
    )
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("one").alias("one"), F.max("other").alias("other"))
    pairs = pairs.where(enough_shared(F.col("one"), F.col("other"), percent)).select("a", "b")
    return written(pairs.join(asked, ["a", "b"], "left_anti"), "jaccard-more")


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, the id with a number for null, and ``mark``, a hash of the text; both together name a text."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("key"), F.xxhash64("text").alias("mark"), "*")


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two rows link when 100 * common shingles >= ``percent`` * shingles of either;
    the component is the smallest ``doc_id`` reachable by links.  Rows of equal
    sets are one node; rows that repeat an id are classed each by its own text;
    an empty text links with nothing.  A null id is an id of its own that sorts first.  Texts of fewer words than a shingle are one
    shingle, null is an empty text, an empty table gives an empty one.  Sets and
    members are compared by 64-bit hashes.
    """
    as_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    shown = classed(docs, **options)
    return shown.select(as_id("key").alias("doc_id"), F.col("n").alias("n_shingles"), as_id("component").alias("component_id"))


def classed(docs: DataFrame, percent: int = 75, sample_docs: int = 32_000, most_frequent: int = 200_000) -> DataFrame:
    """``key, mark, n, set_id, class, component`` of every row; an empty text is in no class.

    A class is named by one of its sets, so two classes may share the id that names their component.
    """
    keyed = marked(docs.select("doc_id", "text")).drop("doc_id")
    index = written(indexed(keyed, frequent_members(keyed, sample_docs, most_frequent), percent), "jaccard-index")
    nodes = written(index.where("n > 0").groupBy("set_id", "n").agg(F.min(F.struct("key", "mark")).alias("rep")), "jaccard-nodes")

    # Index lists with more than one set.  A list asks its leader about the sets
    # that share enough of the leader's lists; the rest stays open.
    entries = index.where("n > 0").select("set_id", "n", F.posexplode("prefix").alias("pos", "member"))
    lists = entries.groupBy("member").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("other")).where("leader <> other")
    posted = entries.join(lists.drop("other"), "member").select("member", "leader", "set_id", "n", "pos").distinct()
    posted = written(posted, "jaccard-lists")
    own = nodes.select(F.col("set_id").alias("leader"), F.col("n").alias("leader_n"))
    own = nodes.select(F.col("set_id").alias("leader"), F.col("n").alias("leader_n"))
    star = posted.where("set_id <> leader").groupBy("leader", "set_id", "n").agg(F.count("*").alias("shared")).join(own, "leader")
    star = star.where(
        similar_sizes(F.col("n"), F.col("leader_n"), percent) & enough_shared(F.col("n"), F.col("leader_n"), percent)
    )
    star = written(star.select(F.col("leader").alias("a"), F.col("set_id").alias("b")), "jaccard-star")
    told = written(verified(star, nodes, keyed), "jaccard-told")
    linked = F.expr(f"common * 100 >= (na + nb - common) * {percent}")
    edges = lambda rows: rows.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = components(edges(told), "jaccard-classes")
    long = posted.groupBy("member").agg(F.count("*").alias("length")).where(f"length >= {LONG_LIST}").select("member")
    long = written(posted.join(long, "member").select("member", "set_id", "n"), "jaccard-long")
    hubs = long.groupBy("set_id").agg(F.count("*").alias("lists"))
    long = written(long.join(hubs, "set_id"), "jaccard-long")
    asked_before = star
    for turn in range(ROUNDS):
        more = more_leaders(long, classes, asked_before, turn, percent)
        if more.isEmpty():
            break
        asked_before = asked_before.union(more)
        found = written(verified(more, nodes, keyed), "jaccard-told")
        merged = classes.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges(found))
        classes = components(merged, "jaccard-classes")

    # Questions the leaders leave open: sets of one list in different classes.
    limit = 1 - percent / 100
    slack = limit + 1e-9
    answers = told.select(
        F.col("a").alias("leader"), F.col("b").alias("set_id"),
        (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("known"),
    )
    class_of = nodes.join(classes, nodes.set_id == classes.node, "left").select(
        "set_id", F.coalesce("component", "set_id").alias("class")
    )
    far = F.when(F.col("set_id") == F.col("leader"), 0.0).otherwise(F.col("known"))
    rows = posted.join(class_of, "set_id").join(answers, ["leader", "set_id"], "left")
    rows = rows.join(class_of.select(F.col("set_id").alias("leader"), F.col("class").alias("leader_class")), "leader")
    rows = written(
        rows.select(
            "member", "set_id", "n", "pos", "class", (F.col("class") == F.col("leader_class")).alias("near"),
            F.coalesce(far, F.lit(0.0)).alias("least"), F.coalesce(far, F.lit(1.0)).alias("most"),
        ),
        "jaccard-rows",
    )
    nearest = F.min(F.when(~F.col("near"), F.col("least"))).alias("nearest")
    open_lists = rows.groupBy("member").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), nearest).where("lo <> hi")
    asked = rows.join(open_lists.select("member", "nearest"), "member").where(
        ~F.col("near") | (F.col("nearest") - F.col("most") <= slack)
    )
    x, y = asked.where("not near").alias("x"), asked.alias("y")
    pairs = x.join(y, F.expr("x.member = y.member")).where(
        F.expr("x.class <> y.class and (y.near or x.set_id < y.set_id)")
        & F.expr(f"x.least - y.most <= {slack} and y.least - x.most <= {slack}")
        & similar_sizes(F.col("x.n"), F.col("y.n"), percent)
        & reachable_overlap("x", "y", percent)
        & (F.col("x.pos") <= last_place("x", "y", percent)) & (F.col("y.pos") <= last_place("y", "x", percent))
    )
    pairs = pairs.select(
        F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"),
        first_shared(F.col("x.n"), F.col("y.n"), percent).alias("needed"),
    )
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("needed").alias("needed"))
    pairs = pairs.where("shared >= needed").select("a", "b")
    pairs = written(pairs.join(asked_before, ["a", "b"], "left_anti"), "jaccard-asked")
    more = written(verified(pairs, nodes, keyed), "jaccard-more")
    merged = classes.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges(more))
    final = components(merged, "jaccard-final")

    # A component's name is its smallest id.
    member_of = nodes.join(final, nodes.set_id == final.node, "left").select(
        "set_id", "rep", F.coalesce("component", "set_id").alias("class")
    )
    least_id = member_of.groupBy("class").agg(F.min("rep.key").alias("component"))
    named = member_of.join(least_id, "class").select("set_id", "class", "component")
    columns = ["key", "mark", "n", "set_id", "class", "component"]
    shown = index.where("n > 0").join(named, "set_id").select(columns)
    empty = index.where("n = 0").withColumns({"class": F.lit(None).cast("bigint"), "component": F.col("key")})
    return shown.union(empty.select(columns))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of similar texts, all its columns, and every row of an empty text.

    The row is that of the smallest id, null first, then of the smallest set
    hash; of rows alike in id and text one stays.
    """
    order = F.struct("key", "set_id", "mark")
    first = classed(docs, **options).where("n > 0").groupBy("class").agg(F.min(order).alias("first"))
    wanted = first.select(F.col("first.key").alias("key"), F.col("first.mark").alias("mark"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    # Equal rows are made one before they are dealt out, so a text repeated under one id, or none, stays small.
    rows = docs.where(worded).select("doc_id", "text", F.struct("*").alias("row"))
    hashed = F.xxhash64(*[F.col(f"row.{f.name}") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())])
    single = marked(rows).groupBy("key", "mark").agg(F.min_by("row", hashed).alias("row"))
    return single.join(wanted, ["key", "mark"], "left_semi").select("row.*").union(docs.where(~worded))

"""Personal data: patterns, and boosted trees over candidates the patterns miss.

Column functions only.  Base matches are found by pattern and check.  Generators
with looser bounds propose further, overlapping spans; those that meet a base
match say what a right span looks like, and boosted trees carry that over to
spans the base patterns run past, such as a number glued to its neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .common import text_of, written

# The kinds, in order.
KINDS = ("email", "ip", "card", "phone")

# Base patterns.  A run of the leading class can only match from its start or
# from where the last match ended, which keeps long runs linear; possessive
# loops keep the matcher's stack flat.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Generators: looser or tighter readings of each kind.
GENERATORS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{2,7}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{14,19}+(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){3}(?![0-9])"),
)

#: A text without this cannot match any pattern of the kind.
NEEDS = {"email": r"@|at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

FEATURES = ("kind", "digits", "groups", "luhn", "octets", "marks", "before", "after")
SPAN = "struct<start:int,kind:int,stop:int>"


@dataclass(frozen=True)
class PiiModel:
    trees: Boosted
    #: The least margin that redacts, by kind; none: nothing is added.
    least: tuple[float | None, ...]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Arrays are folded in stretches of this length, as a fold copies what it has gathered.
STRETCH = 256


def running(x: Column, merge, zero: int) -> Column:
    """Running ``merge`` of an array of integers, each with its predecessors.

    The stretches of an array are folded each from where the one before ends,
    which a running merge of the stretches' own results says; that one is short.
    """
    zero_ = F.lit(zero).cast("int")

    def plain(part: Column, start: Column) -> Column:
        begin = F.array(start.cast("int"))
        folded = F.aggregate(part, begin, lambda out, v: F.array_append(out, merge(F.element_at(out, -1), v)))
        return F.slice(folded, F.lit(2), F.size(part))

    def joined(parts: Column) -> Column:
        ends = plain(F.transform(parts, lambda p: F.aggregate(p, zero_, merge)), zero_)
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, j: plain(p, F.coalesce(F.get(e, j - 1), zero_)))))

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i % STRETCH == 0) & (i < F.size(x)))
        return let(F.transform(starts, lambda i: F.slice(x, i + 1, F.lit(STRETCH))), joined)

    return let(x, cut)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def found(text: Column, pattern: str, needs: str) -> Column:
    """All matches from left to right as ``struct(start, stop, v, before, after)``: code points, end exclusive, and the characters beside."""
    nothing = F.lit([]).cast("array<struct<start:int,stop:int,v:string,before:string,after:string>>")

    def walk(x: Column) -> Column:
        m, between = x["m"], x["between"]
        steps = F.transform(between, lambda b, i: F.length(b) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        starts = running(F.slice(steps, F.lit(1), F.size(m)), lambda a, v: a + v, 0)

        def span(start: Column, i: Column) -> Column:
            match, left, right = F.get(m, i), F.get(between, i), F.get(between, i + 1)
            before = F.when(left != "", F.right(left, F.lit(1))).otherwise(F.right(F.coalesce(F.get(m, i - 1), F.lit("")), F.lit(1)))
            after = F.when(right != "", F.left(right, F.lit(1))).otherwise(F.left(F.coalesce(F.get(m, i + 1), F.lit("")), F.lit(1)))
            return F.struct(
                start.alias("start"), (start + F.length(match)).alias("stop"), match.alias("v"), before.alias("before"), after.alias("after")
            )

        return F.when(F.size(m) > 0, F.transform(starts, span)).otherwise(nothing)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between")
    )
    return F.when(text.rlike(needs), let(parts, walk)).otherwise(nothing)


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check of a number of at most 19 digits: every second digit from the right doubled."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def octets_fit(v: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(v, r"\."), fits)


def passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        return octets_fit(v)
    if kind == "card":
        return F.when(F.length(digits_of(v)).between(14, 19), luhn(digits_of(v))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(v)).between(10, 15)
    return F.lit(True)


def base_matches(text: Column) -> Column:
    """Matches of all base patterns as ``struct(start, kind, stop, ok)``."""

    def of(no: int, kind: str) -> Column:
        return F.transform(
            found(text, BASE[kind], NEEDS[kind]),
            lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["stop"].alias("stop"), passes(kind, m["v"]).alias("ok")),
        )

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def candidates(text: Column) -> Column:
    """Proposals with their features: ``struct(start, kind, stop, digits, groups, ...)``, in order, each once."""

    def side(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(1)

    def of(no: int, kind: str, pattern: str) -> Column:
        def features(m: Column) -> Column:
            v = m["v"]
            return F.struct(
                m["start"].alias("start"), F.lit(no).alias("kind"), m["stop"].alias("stop"),
                F.least(F.length(digits_of(v)), F.lit(20)).alias("digits"),
                F.least(F.size(F.array_remove(F.split(v, "[^0-9]+"), "")), F.lit(8)).alias("groups"),
                luhn(digits_of(v)).cast("int").alias("luhn"),
                (octets_fit(v).cast("int") if kind == "ip" else F.lit(0)).alias("octets"),
                v.rlike(r"[(\[]").cast("int").alias("marks"),
                side(m["before"]).alias("before"), side(m["after"]).alias("after"),
            )

        return F.transform(found(text, pattern, NEEDS[kind]), features)

    # Equal proposals have equal features, so neighbours in order tell.
    every = F.array_sort(F.concat(*[of(KINDS.index(k), k, p) for k, p in GENERATORS]))
    return let(every, lambda s: F.filter(s, lambda c, i: ~F.coalesce(same_span(c, F.get(s, i - 1)), F.lit(False))))


def same_span(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["kind"] == b["kind"]) & (a["stop"] == b["stop"])


def spotted(text: Column) -> Column:
    """``struct(base, candidates)`` of a text; candidates carry a label.

    1 or 0 where the span is a base match, by its check; 0 where it cuts or
    overruns a good base match; null where base says nothing about it.  Base and
    candidates are merged in order of their starts: a candidate meets a good base
    match if one that starts no later reaches beyond its start, or the next one
    starts before its end.
    """
    far = 2**31 - 1

    def event(s: Column, base: bool) -> Column:
        known = {"ok": s["ok"]} if base else {n: s[n] for n in FEATURES if n != "kind"}
        blank = {n: F.lit(None).cast("int") for n in FEATURES if n != "kind"} if base else {"ok": F.lit(None).cast("boolean")}
        fields = {"start": s["start"], "kind": s["kind"], "stop": s["stop"], "proposed": F.lit(not base)} | known | blank
        order = ("start", "kind", "stop", "proposed", "ok", *[n for n in FEATURES if n != "kind"])
        return F.struct(*[fields[n].alias(n) for n in order])

    def judged(x: Column) -> Column:
        good = lambda e: F.coalesce(e["ok"], F.lit(False))

        def labelled(events: Column) -> Column:
            reach = running(F.transform(events, lambda e: F.when(good(e), e["stop"]).otherwise(-1)), later, -1)
            follow = running(F.reverse(F.transform(events, lambda e: F.when(good(e), e["start"]).otherwise(far))), earlier, far)

            def mark(y: Column) -> Column:
                def label(e: Column, i: Column) -> Column:
                    last = F.get(events, i - 1)
                    same = F.coalesce(same_span(e, last) & ~last["proposed"], F.lit(False))
                    meets = (F.get(y["reach"], i) > e["start"]) | (F.get(y["follow"], F.size(events) - 1 - i) < e["stop"])
                    return F.when(same & good(last), 1).when(same | meets, 0)

                all_of = F.transform(
                    events, lambda e, i: F.struct(*[e[n].alias(n) for n in ("start", "stop", *FEATURES, "proposed")], label(e, i).alias("label"))
                )
                return F.transform(
                    F.filter(all_of, lambda e: e["proposed"]), lambda e: F.struct(*[e[n].alias(n) for n in ("start", "stop", *FEATURES, "label")])
                )

            return let(F.struct(reach.alias("reach"), follow.alias("follow")), mark)

        spans = F.transform(
            F.filter(x["base"], lambda b: b["ok"]),
            lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")),
        )
        events = F.array_sort(F.concat(F.transform(x["base"], lambda b: event(b, True)), F.transform(x["found"], lambda c: event(c, False))))
        none = F.lit([]).cast(f"array<struct<start:int,stop:int,{','.join(f'{n}:int' for n in FEATURES)},label:int>>")
        labels = F.when(F.size(x["found"]) > 0, let(events, labelled)).otherwise(none)
        return F.struct(F.array_sort(spans).alias("base"), labels.alias("candidates"))

    both = F.struct(base_matches(text).alias("base"), candidates(text).alias("found"))
    return let(both, judged)


def train_pii(seen: DataFrame, precision: float = 0.98, fold: int = 4) -> PiiModel:
    """Model of a table with ``doc_id`` and ``spotted``.

    All labelled candidates count, as weights of their distinct features.  One
    document in ``fold``, by hash, is held out; on these a kind's threshold is
    the least margin from which on the share of right spans is ``precision``.
    """
    held = F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(fold)) == 0
    counts = (
        seen.select(held.alias("held"), F.explode("spotted.candidates").alias("c")).where("c.label is not null")
        .groupBy("held", *[F.col(f"c.{n}").alias(n) for n in FEATURES])
        .agg(F.sum("c.label").alias("positive"), F.count("*").alias("total")).collect()
    )
    rows = sorted((tuple(r[n] for n in FEATURES), r.held, r.positive, r.total) for r in counts)
    fitted = [r for r in rows if not r[1]] or rows
    tried = [r for r in rows if r[1]] or rows
    table = lambda rs: (
        np.array([r[0] for r in rs], dtype=np.int64).reshape(-1, len(FEATURES)),
        np.array([r[2] for r in rs], dtype=float), np.array([r[3] for r in rs], dtype=float),
    )
    trees = boost(*table(fitted))
    x, positive, total = table(tried)
    margin = trees.margins(x)
    least: list[float | None] = []
    for kind in range(len(KINDS)):
        of = x[:, 0] == kind
        cuts = [m for m in np.unique(margin[of & (positive > 0)])
                if positive[of & (margin >= m)].sum() >= precision * total[of & (margin >= m)].sum()]
        least.append(float(min(cuts)) - 1e-9 if cuts else None)
    return PiiModel(trees, tuple(least))


def all_spans(x: Column, model: PiiModel) -> Column:
    """Base spans and the candidates the model adds, in order: ``array<struct<start, kind, stop>>``.

    A candidate is added if its margin reaches its kind's threshold, it meets no
    base span and no better candidate: a higher margin, then fewer characters,
    then the earlier start and kind.  Candidates are compared within runs that
    overlap; as each generator's spans are apart and of bounded length, runs are short.
    """
    thresholds = F.array(*[F.lit(v).cast("double") for v in model.least])
    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    better = lambda a, b: F.struct(*[a[n] for n in ("cost", "length", "start", "kind")]) < F.struct(*[b[n] for n in ("cost", "length", "start", "kind")])

    def choose(x: Column) -> Column:
        # Unlabelled candidates meet no base span.
        rated = F.transform(
            F.filter(x["candidates"], lambda c: c["label"].isNull()),
            lambda c: F.struct(
                c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"),
                (-model.trees.margin([c[n] for n in FEATURES])).alias("cost"), (c["stop"] - c["start"]).alias("length"),
            ),
        )
        able = F.filter(rated, lambda c: F.coalesce(-c["cost"] >= F.element_at(thresholds, c["kind"] + 1), F.lit(False)))

        def best(y: Column) -> Column:
            reach = running(F.transform(y, lambda c: c["stop"]), later, -1)

            def runs(r: Column) -> Column:
                begins = F.filter(F.transform(y, lambda c, i: F.when(F.coalesce(F.get(r, i - 1), F.lit(-1)) <= c["start"], i)), lambda i: i.isNotNull())
                return let(begins, lambda b: F.transform(b, lambda at, j: F.slice(y, at + 1, F.coalesce(F.get(b, j + 1), F.size(y)) - at)))

            kept = F.flatten(F.transform(let(reach, runs), lambda g: F.filter(g, lambda c: ~F.exists(g, lambda o: meets(o, c) & better(o, c)))))
            added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
            return F.array_sort(F.concat(x["base"], added))

        return F.when(F.size(x["candidates"]) > 0, let(able, lambda y: F.when(F.size(y) > 0, best(y)).otherwise(x["base"]))).otherwise(x["base"])

    return let(x, choose)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    )


def spot(docs: DataFrame) -> DataFrame:
    """``doc_id, spotted`` of every row, written once: one pass over the texts."""
    return written(docs.select("doc_id", spotted(text_of()).alias("spotted")), "pii-spotted")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base`` and ``spans``.

    The last two are arrays of ``struct(start, kind, stop)``.  Null is an empty
    text; an empty table gives an empty one; repeated rows are read each; without
    labelled candidates of a kind none of that kind is added.
    """
    seen = spot(docs)
    model = train_pii(seen, **options)
    count = lambda no: F.size(F.filter("spotted.base", lambda s: s["kind"] == no)).cast("bigint")
    return seen.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.col("spotted.base").alias("base"),
        all_spans(F.col("spotted"), model).alias("spans"),
    )


#: Texts are cut into pieces of so many characters, since a substring is looked for from the start of its text.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(x: Column) -> Column:
        s, pieces = x["spans"], x["pieces"]

        def between(start: Column, stop: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            count = F.floor((stop - 1) / PIECE).cast("int") - first + 1
            return F.when(stop <= start, F.lit("")).otherwise(
                F.substr(F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), ""), start - first * PIECE + 1, stop - start)
            )

        def replaced(reach: Column) -> Column:
            def part(span: Column, i: Column) -> Column:
                last = F.coalesce(F.get(reach, i - 1), F.lit(0))
                new = F.concat(between(last, span["start"]), F.element_at(marks, span["kind"] + 1))
                return F.when(span["start"] >= last, new).otherwise(F.lit(""))

            rest = between(F.element_at(reach, -1), x["length"])
            return F.concat(F.array_join(F.transform(s, part), ""), rest)

        return let(running(F.transform(s, lambda c: c["stop"]), later, 0), replaced)

    parts = F.struct(
        spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("length")
    )
    return F.when(F.size(spans) > 0, let(parts, cut)).otherwise(text)


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all their columns, personal data in ``text`` replaced and ``n_chars`` counted anew.

    A null text stays null.
    """
    model = train_pii(spot(docs), **options)
    # A column each, since one expression of all would be too deep.
    seen = docs.withColumn("_pii_spotted", spotted(text_of()))
    spans = seen.withColumn("_pii_spans", all_spans(F.col("_pii_spotted"), model)).drop("_pii_spotted")
    clean = F.when(F.col("text").isNotNull(), redacted(text_of(), F.col("_pii_spans")))
    changed = spans.withColumn("text", clean).drop("_pii_spans")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return changed

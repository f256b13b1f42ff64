"""Licence scans, in column functions only.

Lines that speak of a licence, the comments and paragraphs around them, and
licence files as a whole are compared with templates of notices, of headers and
of full licence texts by the cosine of sparse TF-IDF vectors.  Files without a licence of
their own inherit that of the nearest folder above that has a licence file.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rows, text_of, written
from .pii import let

# What licences are called and how notices word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("ISC", "Licensed under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain, see the Unlicense"),
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
# Headers that span lines.  What follows # tells the headers of one licence apart.
HEADERS = (
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("program", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0#1",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
)
TEXTS = Path(__file__).parent / "license_texts"
# Licence texts that also stand at the head of files.
SHORT = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense")
# A block without one of these is no header.
BLOCK_ANCHORS = "(?i)licen[cs]|public domain|spdx|permission\\s|redistribution"
# Blank lines, and lines of comment signs alone.
BLANK, BARE = r"\r?\n[ \t]*\r?\n", r"\r?\n[ \t]*[#*/;%!-]*[ \t]*(?=\r?\n)"
# A line without one of these is no notice.
ANCHORS = "(?i)licen[cs]|copyright|public domain|spdx"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
LEAST = 0.75


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sections(files: DataFrame) -> DataFrame:
    """``path, mark, section``: every line of a text with an anchor, and the whole text of licence files that have one.

    ``mark`` is the MD5 of the section, which stands for it where terms are counted.
    """
    text = text_of()
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(ANCHORS)), lambda x: F.trim(x))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    found = files.where(F.col("path").isNotNull() & text.rlike(ANCHORS))
    cut = found.select("path", F.explode(F.array_distinct(F.concat(lines, whole))).alias("section"))
    return cut.withColumn("mark", F.md5("section"))


def full_texts() -> tuple[tuple[str, str], ...]:
    """Full licence texts; that of AGPL-3.0 is the one of GPL-3.0 with its own name."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    affero = texts["GPL-3.0"].replace("GNU General Public", "GNU Affero General Public").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    return tuple((texts | {"AGPL-3.0": affero}).items())


def header_templates() -> tuple[tuple[str, str], ...]:
    return (*HEADERS, *((name, text) for name, text in full_texts() if name in SHORT))


def blocks(files: DataFrame) -> DataFrame:
    """``path, mark, section``: comments and paragraphs of several lines with an anchor."""
    text = text_of()
    several = lambda x: x.contains("\n") & x.rlike(BLOCK_ANCHORS)
    cut = F.transform(F.concat(F.split(text, BLANK), F.split(text, BARE)), lambda x: F.trim(x))
    found = files.where(F.col("path").isNotNull() & text.contains("\n") & text.rlike(BLOCK_ANCHORS))
    found = found.select("path", F.explode(F.array_distinct(F.filter(cut, several))).alias("section"))
    return found.withColumn("mark", F.xxhash64("section"))


def whole_files(files: DataFrame) -> DataFrame:
    """``path, mark, section``: the whole text of licence files."""
    found = files.where(F.col("path").rlike(LICENSE_FILE)).select("path", F.trim(text_of()).alias("section"))
    return found.withColumn("mark", F.xxhash64("section"))


def template_rows(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    return bounded_rows(spark, templates, "license string, template string", 10_000)


def counted(terms: Column) -> Column:
    """``struct(term, tf)`` of the distinct terms of an array: sorted, then the lengths of the runs."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        length = lambda b, p, i: F.coalesce(F.get(b, i + 1), F.size(s)) - p
        return let(begins, lambda b: F.transform(b, lambda p, i: F.struct(F.get(s, p).alias("term"), length(b, p, i).alias("tf"))))

    nothing = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(nothing))


def once(found: DataFrame) -> DataFrame:
    """Sections without those that a path repeats; texts are shuffled only for these."""
    again = found.groupBy("path", "mark").agg(F.count("*").alias("times")).where("times > 1").select("path", "mark")
    again = written(again, "license-again")
    if again.isEmpty():
        return found
    return found.join(again, ["path", "mark"], "left_anti").union(
        found.join(again, ["path", "mark"], "left_semi").select(found.columns).dropDuplicates(["path", "mark"])
    )


def similar_templates(found: DataFrame, templates: tuple, least: float = LEAST) -> DataFrame:
    """``path, license, similarity`` of each section whose best template reaches ``least``.

    A term's weight is its count times ``ln((1 + n) / (1 + df)) + 1``, with ``n``
    and ``df`` counted over all sections of all files, and the templates.  A
    cosine is at most the root of the share that the templates' terms have of a
    section's squared weights, and every other term weighs 1 at least; sections
    ruled out by this never leave their row.
    """
    spark = found.sparkSession
    found = once(found)
    rows = template_rows(spark, templates)
    wanted = rows.select("license", F.explode(terms_of(F.col("template"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("tf"))
    wanted = wanted.collect()
    own = Counter(r.term for r in wanted)
    seen = found.select(F.explode(F.array_distinct(terms_of(F.col("section")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = written(seen, "license-terms")
    n = found.count() + len(templates)
    df = {r.term: r.df for r in seen.where(F.col("term").isin(*own)).collect()} if own else {}
    weights = {t: math.log((1 + n) / (1 + df.get(t, 0) + own[t])) + 1 for t in own}
    sizes: Counter[str] = Counter()
    for r in wanted:
        sizes[r.license] += (r.tf * weights[r.term]) ** 2
    goals = [(r.license, r.term, r.tf * weights[r.term] / math.sqrt(sizes[r.license])) for r in wanted]
    goals = bounded_rows(spark, goals, "license string, t_term string, t_w double", 100_000)
    terms = terms_of(F.col("section"))
    able = within_bound(weights, lambda t, on: on + F.size(F.filter(t, lambda x: ~x.isin(*weights))), least)
    likely = written(found.where(able(terms)).select("path", "mark", "section"), "license-likely")
    vectors = likely.groupBy("mark").agg(F.min("section").alias("section")).select("mark", F.explode(counted(terms)).alias("c")).select("mark", "c.*")
    extra = bounded_rows(spark, list(own.items()), "o_term string, more bigint", 100_000)
    dfs = seen.join(extra, F.col("term") == F.col("o_term"), "left").select("term", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))
    weighed = vectors.join(dfs, "term").select("mark", "term", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    size = weighed.groupBy("mark").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(goals, F.col("term") == F.col("t_term")).groupBy("mark", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    rated = dots.join(size, "mark").select("mark", "license", F.round(F.col("dot") / F.col("size"), 6).alias("similarity"))
    named = written(best(rated.where(F.col("similarity") >= least), ["mark"]), "license-named")
    return likely.select("path", "mark").join(named, "mark").select("path", "license", "similarity")


def squares(terms: Column, weights: dict[str, float], rest: float) -> Column:
    """Sum of the squared weights of a section's terms; terms without a weight have ``rest``.

    Templates are few, so weights have few values: one look-up in a set of terms each.
    """
    classes: dict[float, list[str]] = defaultdict(list)
    for term, w in sorted(weights.items()):
        classes[w].append(term)

    def square(c: Column) -> Column:
        weight = F.lit(rest)
        for w, members in sorted(classes.items()):
            weight = F.when(c["term"].isin(*members), F.lit(w)).otherwise(weight)
        return let(c["tf"] * weight, lambda x: x * x)

    return F.aggregate(counted(terms), F.lit(0.0), lambda total, c: total + square(c))


def within_bound(weights: dict[str, float], all_of, least: float):
    """Whether terms with ``weights`` have ``least**2`` of a section's squared weights, ``all_of`` terms and those, at least."""

    def able(terms: Column) -> Column:
        on = lambda t: squares(F.filter(t, lambda x: x.isin(*weights)), weights, 0.0)
        return let(terms, lambda t: let(on(t), lambda x: (x > 0) & (x * (1 + 1e-9) >= least**2 * all_of(t, x))))

    return able


def similar_texts(found: DataFrame, templates: tuple, least: float) -> DataFrame:
    """``path, license, similarity`` of each section whose best template reaches ``least``.

    As ``similar_templates``, but ``n`` and ``df`` are counted over the templates
    alone, so a section's squared weights are known in its row.  Where the
    templates' terms have less than ``least**2`` of them no cosine reaches
    ``least``; only the other sections are compared.
    """
    spark = found.sparkSession
    goals = template_rows(spark, templates).select("license", F.explode(terms_of(F.col("template"))).alias("term"))
    goals = goals.groupBy("license", "term").agg(F.count("*").alias("tf")).collect()
    df = Counter(r.term for r in goals)
    weight = lambda n: math.log((1 + len(templates)) / (1 + n)) + 1
    weights = {t: weight(n) for t, n in df.items()}
    sizes: Counter[str] = Counter()
    for r in goals:
        sizes[r.license] += (r.tf * weights[r.term]) ** 2
    known = [(r.license, r.term, r.tf * weights[r.term] ** 2 / math.sqrt(sizes[r.license])) for r in goals]
    known = bounded_rows(spark, known, "license string, t_term string, t_w double", 1_000_000)
    terms = terms_of(F.col("section"))
    all_of = lambda t: squares(t, weights, weight(0))
    # The first bound is cheap: each other term weighs as a term of no template at least once.
    first = within_bound(weights, lambda t, on: on + weight(0) ** 2 * F.size(F.filter(t, lambda x: ~x.isin(*weights))), least)
    second = within_bound(weights, lambda t, on: all_of(t), least)
    able = found.where(F.when(first(terms), second(terms)).otherwise(F.lit(False)))
    able = written(able.select("path", "mark", "section", F.sqrt(all_of(terms)).alias("size")), "license-able")
    vectors = able.groupBy("mark").agg(F.min("section").alias("section"), F.min("size").alias("size"))
    vectors = vectors.select("mark", "size", F.explode(counted(terms)).alias("c")).select("mark", "size", "c.*")
    dots = vectors.join(known, F.col("term") == F.col("t_term")).groupBy("mark", "size", "license").agg(F.sum(F.col("tf") * F.col("t_w")).alias("dot"))
    rated = dots.select("mark", "license", F.round(F.col("dot") / F.col("size"), 6).alias("similarity"))
    named = written(best(rated.where(F.col("similarity") >= least), ["mark"]), "license-named")
    return able.select("path", "mark").join(named, "mark").select("path", "license", "similarity")


def best(rated: DataFrame, key: list[str]) -> DataFrame:
    """The row of the highest ``similarity`` of each key, the first name of equals."""
    top = rated.groupBy(*key).agg(F.max("similarity").alias("similarity"))
    return rated.join(top, [*key, "similarity"]).groupBy(*key, "similarity").agg(F.min("license").alias("license"))


def folder_of(path: Column) -> Column:
    """Folder of a path, without a slash at its end; empty for the root."""
    return F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")


def scan_licenses(files: DataFrame, least: float = LEAST, templates: tuple = TEMPLATES) -> DataFrame:
    """``path, license, similarity, origin, from_path`` of every row of ``files`` (``path``, ``text``).

    Of a file's own licences that of its whole text counts before those of its
    headers, and these before those of single lines, by similarity each.
    ``origin`` is ``own``, ``inherited`` or ``none``; an inherited licence names
    the licence file it comes from, of several in a folder the most similar, then
    the first by path.  Rows that repeat a path are one file.  A null text has no
    notice; a null path has none and inherits none; an empty table gives an empty
    one.
    """
    narrow = files.select("path", "text")
    parts = ((sections, templates, similar_templates), (blocks, header_templates(), similar_texts), (whole_files, full_texts(), similar_texts))
    rated = [
        compare(cut(narrow), goals, least).select("path", F.lit(rank).alias("rank"), "license", "similarity")
        for rank, (cut, goals, compare) in enumerate(parts)
    ]
    rated = written(reduce(DataFrame.union, rated).distinct(), "license-rated")
    # A full text says more than a header, and a header more than a line of it.
    top = rated.groupBy("path").agg(F.max("rank").alias("rank"))
    own = best(rated.join(top, ["path", "rank"]).select("path", "license", "similarity"), ["path"])
    own = written(own.withColumn("license", F.substring_index("license", "#", 1)), "license-own")
    # Folders with a licence file, joined with the folders below them.
    kept = own.where(F.col("path").rlike(LICENSE_FILE)).withColumn("folder", folder_of(F.col("path")))
    top = kept.groupBy("folder").agg(F.max("similarity").alias("similarity"))
    chosen = kept.join(top, ["folder", "similarity"]).groupBy("folder", "similarity").agg(
        F.min("path").alias("from_path"), F.min_by("license", "path").alias("license")
    )
    folders = files.where("path is not null").select(folder_of(F.col("path")).alias("below")).distinct()
    parts = F.split("below", "/")
    above = folders.select(
        "below", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).alias("depth", "folder")
    )
    nearest = above.join(chosen, "folder").groupBy("below").agg(
        F.max_by(F.struct("license", "similarity", "from_path"), "depth").alias("near")
    )
    mine = own.select("path", F.struct("license", "similarity").alias("own"))
    rows = files.withColumn("_folder", folder_of(F.col("path"))).join(mine, "path", "left").join(nearest, F.col("_folder") == F.col("below"), "left")
    owned, near = F.col("own").isNotNull(), F.col("near").isNotNull()
    return rows.select(
        *[c for c in ("doc_id",) if c in files.columns], "path",
        F.when(owned, F.col("own.license")).otherwise(F.col("near.license")).alias("license"),
        F.when(owned, F.col("own.similarity")).otherwise(F.col("near.similarity")).alias("similarity"),
        F.when(owned, "own").when(near, "inherited").otherwise("none").alias("origin"),
        F.when(~owned, F.col("near.from_path")).alias("from_path"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: documents as files of a tree of source, language and shelf.

    Of eight documents by id one is a licence file of its shelf, one of its
    language and one of its source.
    """
    top, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    shelf, turn, name = F.pmod("doc_id", F.lit(64)).cast("string"), F.pmod("doc_id", F.lit(8)), F.col("doc_id").cast("string")
    path = (
        F.when(turn == 0, F.concat_ws("/", top, lang, shelf, F.concat(F.lit("LICENSE."), name)))
        .when(turn == 1, F.concat_ws("/", top, lang, F.concat(F.lit("LICENSE."), name)))
        .when(turn == 2, F.concat_ws("/", top, F.concat(F.lit("LICENSE."), name)))
        .otherwise(F.concat_ws("/", top, lang, shelf, F.concat(name, F.lit(".txt"))))
    )
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")

"""Cosines of licence sections against plain dictionaries."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from framewarden.llm import licenses


def vector(text):
    return collections.Counter(re.findall(licenses.TERM, text.lower()))


def cosines(sections, templates, least, counted):
    """``{section: (license, similarity)}``; ``counted`` are the texts that document frequencies come from."""
    df = collections.Counter(t for text in counted for t in vector(text))
    weight = lambda t: math.log((1 + len(counted)) / (1 + df[t])) + 1
    weigh = lambda text: {t: n * weight(t) for t, n in vector(text).items()}
    size = lambda v: math.sqrt(sum(w * w for w in v.values()))
    goals = {name: weigh(text) for name, text in templates}
    out = {}
    for section in set(sections):
        v = weigh(section)
        found = [(-round(sum(w * g.get(t, 0) for t, w in v.items()) / (size(v) * size(g)), 6), name) for name, g in goals.items() if v]
        if found and -min(found)[0] >= least:
            out[section] = (min(found)[1], -min(found)[0])
    return out


def mixtures(templates, n, seed):
    """Templates with words left out, repeated or strewn in, from nearly all of one to none."""
    pick = random.Random(seed)
    strange = [f"w{i}" for i in range(200)]
    out = ["", "no terms of any template", "!!"]
    for _ in range(n):
        terms = pick.choice(templates)[1].split()
        kept = [t for t in terms if pick.random() < pick.choice([0.5, 0.8, 0.95, 1])]
        out.append(" ".join(kept + pick.choices(strange, k=int(len(terms) * pick.choice([0, 0.1, 0.3, 0.6, 2])))))
    return out + out[:20]


@pytest.mark.parametrize("least", [0.75, 0.4])
def test_lines_and_texts_find_every_similar_section(spark, least):
    texts = mixtures(licenses.TEMPLATES, 150, 1)
    rows = [(f"p{i % 130}", text) for i, text in enumerate(texts)]
    found = spark.createDataFrame(rows, "path string, section string").withColumn("mark", F.md5("section"))
    distinct = sorted(set(rows))
    want = cosines(texts, licenses.TEMPLATES, least, [t for _, t in distinct] + [t for _, t in licenses.TEMPLATES])
    got = licenses.similar_templates(found, licenses.TEMPLATES, least).collect()
    check(got, [(p, *want[t]) for p, t in distinct if t in want])

    goals = licenses.header_templates()
    texts = mixtures(goals, 60, 2)
    rows = [(f"p{i}", text) for i, text in enumerate(texts)]
    found = spark.createDataFrame(rows, "path string, section string").withColumn("mark", F.xxhash64("section"))
    want = cosines(texts, goals, least, [t for _, t in goals])
    check(licenses.similar_texts(found, goals, least).collect(), [(p, *want[t]) for p, t in rows if t in want])


def check(got, want):
    assert want and sorted(r[:2] for r in got) == sorted(r[:2] for r in want)
    assert sorted(r[2] for r in got) == pytest.approx(sorted(r[2] for r in want), abs=2e-6)


def test_counted_terms(spark):
    rows = [([],), (["b", "a", "b"],), (["x"] * 1000,), (["c", "a"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(licenses.counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[], [("a", 1), ("b", 2)], [("x", 1000)], [("a", 1), ("c", 1)]]

"""Candidates, their labels and the choice among them against plain loops, and texts with very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from framewarden.llm import pii
from framewarden.llm.boosting import Boosted

NO_TREES = Boosted(0.0, ())


def odd_texts(n, seed):
    pick = random.Random(seed)
    parts = ["1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (843) 555-7672", "+49 170 123", "+1", "4539578763621486", "4539 5787 6362 1487", "a@b.c",
             "x (at) y.de", "me [at] 10.0.0.1 (dot) net", "é", "😀", " ", "  ", "\n", ".", "-", "12", "word", "@", "(", ")"]
    return [(i, "".join(pick.choices(parts, k=pick.randint(0, 60)))) for i in range(n)]


def plain_found(text, pattern):
    out = []
    for m in re.finditer(pattern.replace("(?:(?<![A-Za-z0-9._%+-])|\\G)", "").replace("(?:(?<![0-9])|\\G)", ""), text):
        out.append((m.start(), m.end(), m.group(), text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]))
    return out


def test_matches_and_the_characters_beside_them(spark):
    texts = odd_texts(300, 1)
    for kind in pii.KINDS:
        frame = spark.createDataFrame(texts, "doc_id bigint, text string")
        for r in frame.select("text", pii.found(F.col("text"), pii.BASE[kind], pii.NEEDS[kind]).alias("m")).collect():
            if re.search(pii.NEEDS[kind], r.text):
                assert [tuple(x) for x in r.m] == plain_found(r.text, pii.BASE[kind])


def test_labels_and_choice_equal_plain_loops(spark):
    names = ("start", "stop", *pii.FEATURES, "label")
    model = pii.PiiModel(NO_TREES, (-1.0, -1.0, None, -1.0))
    frame = spark.createDataFrame(odd_texts(400, 2), "doc_id bigint, text string").select("*", pii.spotted(F.col("text")).alias("x"), pii.base_matches(F.col("text")).alias("b"))
    added = 0
    for r in frame.withColumn("spans", pii.all_spans(F.col("x"), model)).collect():
        base = [(b.start, b.kind, b.stop, b.ok) for b in r.b]
        good = sorted(b[:3] for b in base if b[3])
        assert [tuple(s) for s in r.x.base] == good
        seen, free = [], []
        for c in r.x.candidates:
            span = (c.start, c.kind, c.stop)
            seen.append(span)
            meets = any(s < c.stop and c.start < e for s, _, e in good)
            want = 1 if span in good else 0 if meets or span in [b[:3] for b in base] else None
            assert c.label == want
            if want is None and c.kind != 2:
                free.append((c.stop - c.start, c.start, c.kind, c.stop))
        assert seen == sorted(set(seen)) and tuple(r.x.candidates[0].__fields__ if seen else names) == names
        kept = [f for f in free if not any(o[:3] < f[:3] and o[1] < f[3] and f[1] < o[3] for o in free)]
        assert [tuple(s) for s in r.spans] == sorted(good + [(s, k, e) for _, s, k, e in kept])
        added += len(kept)
    assert added > 50


def test_running_folds(spark):
    rows = [(list(range(n)),) for n in (0, 1, 31, 32, 33, 64, 1000, 40_000)]
    frame = spark.createDataFrame(rows, "x array<int>").select("x", pii.running(F.col("x"), lambda a, b: (a + b) % 1009, 0).alias("y"))
    for r in frame.collect():
        total, want = 0, []
        for v in r.x:
            total = (total + v) % 1009
            want.append(total)
        assert r.y == want


def test_texts_with_very_many_matches_take_time_in_proportion(spark):
    """A hundred thousand numbers, addresses and overlapping candidates in one text each."""
    n = 100_000
    texts = ["12 " * 4 * n, "a@b.c " * n, "x (at) y.de 1.2.3.4 +1 (843) 555-7672 " * (n // 4), "+49 170 12345" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4, "doc_id")
    start = time.perf_counter()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.perf_counter() - start < 120
    assert clean[0] == texts[0] and clean[1] == "[EMAIL] " * n
    assert clean[2].count("[IP]") == clean[2].count("[PHONE]") == n // 4

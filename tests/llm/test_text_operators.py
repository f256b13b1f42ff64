"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewarden.llm import flow, licenses, mixing, multiset_hash, ngram_jaccard, pii, quality, sentencepiece, toxicity
from framewarden.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "an ber co de el fu gra hi jo ka lu mo ne or pa qui ru sta ti um".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts):
    """``(id, text)`` rows with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in texts]
    names = "size bigint, score string"
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + names)


# --- n-gram Jaccard join


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_classes(texts):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        least.setdefault(root(i), []).append(doc)
    low = {r: (None if None in ids else min(ids)) for r, ids in least.items()}
    return sorted(((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(texts)), key=repr)


def near_copies(seed, groups, copies):
    rng = random.Random(seed)
    texts, doc = [], 0
    passage = words(rng, 30)
    for _ in range(groups):
        own = words(rng, rng.randint(6, 90))
        if rng.random() < 0.5:
            own = own + passage
        for _ in range(rng.randint(1, copies)):
            text = list(own)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text[rng.randrange(len(text))] = words(rng, 1)[0]
            texts.append((doc, rng.choice((" ", "\n", " \t")).join(text)))
            doc += 1
    rng.shuffle(texts)
    return texts


def test_jaccard_join_finds_every_link(spark):
    texts = near_copies(1, 40, 9)
    got = sorted(map(tuple, ngram_jaccard.jaccard_join(docs_of(spark, texts)).collect()), key=repr)
    assert got == jaccard_classes(texts)


def test_jaccard_join_on_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "LONG_LIST", 4)
    monkeypatch.setattr(ngram_jaccard, "STAR_ROWS", 8)
    rng = random.Random(5)
    own, texts = words(rng, 60), []
    for i in range(90):
        text = list(own)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = words(rng, 1)[0]
        texts.append((i, " ".join(text)))
    texts += [(200 + i, " ".join(words(rng, 50) + own[:20])) for i in range(20)]
    got = sorted(map(tuple, ngram_jaccard.jaccard_join(docs_of(spark, texts)).collect()), key=repr)
    assert got == jaccard_classes(texts)


def test_jaccard_join_edge_cases(spark):
    texts = [(None, "A b c"), (3, "a B\tc"), (4, None), (5, ""), (6, " \n"), (7, "a b c d"), (8, "é " * 3000), (9, "É " * 3000),
             (10, "é " * 2999), (11, "a b c d e"), (11, "a b c d e"), (12, "x y z"), (12, "a b c d")]
    rows = ngram_jaccard.jaccard_join(docs_of(spark, texts)).collect()
    got = sorted(map(tuple, rows), key=repr)
    assert got == jaccard_classes(texts)
    assert ngram_jaccard.jaccard_join(docs_of(spark, texts).where("doc_id > 99")).count() == 0
    kept = ngram_jaccard.one_of_each_group(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [4, 5, 6, 7, 8, 9, 11, 12]


def test_one_of_each_group_keeps_every_text(spark):
    rng = random.Random(9)
    long = words(rng, 200)
    near = [*long[:199], "other"]
    texts = [
        (None, "one of none"), (None, "two of none"), (None, "two of none"), (None, ""), (None, None), (None, " "), (7, "a b c d"), (12, "x y z"), (12, "a b c d"),
        (12, ""), (12, ""), (3, "x y z"), (20, " ".join(long)), (None, " ".join(near)), (21, "A b C d"), (30, "q r"), (30, "q r"), (30, "Q r"), (31, "s t"), (31, "s u"),
    ]
    kept = ngram_jaccard.one_of_each_group(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    either = [k for k in ((30, "q r"), (30, "Q r")) if got.pop(k, 0)]
    assert len(either) == 1
    assert got == collections.Counter([
        (None, "one of none"), (None, "two of none"), (None, ""), (None, None), (None, " "), (7, "a b c d"), (12, ""), (12, ""), (3, "x y z"),
        (None, " ".join(near)), (31, "s t"), (31, "s u"),
    ])


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(1, n + 1)} | {101: 100}


# --- toxicity


def test_toxicity_separates_held_out_texts(spark):
    rng = random.Random(3)
    bad = ["vequmol", "lostrake", "idiotic", "chllador"]
    texts, labels = [], []
    for i in range(900):
        text, toxic = words(rng, rng.randint(60, 150)), i % 6 == 0
        if toxic:
            for _ in range(len(text) // 15):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs_of(spark, texts), known).collect()
    truth = dict(labels)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    tested = [r for r in got if r.held_out]
    found = [r for r in tested if truth[r.doc_id]]
    assert sum(r.predicted for r in found) >= 0.95 * len(found)
    assert sum(r.predicted for r in tested if not truth[r.doc_id]) <= 0.02 * len(tested)
    again = toxicity.toxicity(docs_of(spark, texts), known).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_toxicity_edge_cases(spark):
    texts = [(None, "a b"), (1, None), (2, ""), (3, "x" * 100_000), (4, "a b"), (4, "a b")]
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs_of(spark, texts), none).collect()
    assert len(rows) == 6 and not any(r.predicted for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = toxicity.drop_toxic(docs_of(spark, texts), none)
    assert kept.columns == docs_of(spark, texts).columns and kept.count() == 6
    assert toxicity.toxicity(docs_of(spark, texts).where("doc_id > 9"), none).count() == 0


def test_toxic_words_of_a_small_language_are_learned():
    rng = random.Random(4)
    small = "zo wip gax yed hule vyn kop".split()
    own = {"en": "idiotic lostrake vequmol".split(), "xx": ["qarzoth"]}

    def text(lang, toxic):
        base = words(rng, 80) if lang == "en" else ["".join(rng.choices(small, k=2)) for _ in range(80)] + ["der", "pan"] 
        for _ in range(5 * toxic):
            base.insert(rng.randrange(len(base)), rng.choice(own[lang]))
        rng.shuffle(base)
        return " ".join(base)

    rows = [(text("en", i % 2), i % 2) for i in range(1200)]
    rows += [(text(lang, i % 10 == 0), int(i % 10 == 0)) for i in range(500) for lang in ("xx",)]
    rng.shuffle(rows)
    model = toxicity.fit(rows)
    found = toxicity.excerpts(*([t for t, y in rows if y == kind] for kind in (1, 0)))
    assert b"qarzo" in model.toxic and b" qarzoth " in found
    scorer = toxicity.Scorer(model)
    for lang, least in (("en", 45), ("xx", 45)):
        assert sum(scorer.score(text(lang, True)) >= 0.7 for _ in range(50)) >= least, lang
        assert sum(scorer.score(text(lang, False)) >= 0.7 for _ in range(50)) <= 2


def test_copies_of_a_toxic_text_are_no_evidence():
    rng = random.Random(6)
    copied = words(rng, 100)
    rows = [(" ".join([*copied, "idiotic"] if i % 4 == 0 else words(rng, 80) + ["idiotic"] * (i % 2 == 0)), int(i % 2 == 0)) for i in range(600)]
    known = toxicity.telling([t for t, y in rows if y], [t for t, y in rows if not y], toxicity.word_pairs)
    assert not any(b" %b %b " % (a.encode(), b.encode()) in known for a, b in zip(copied, copied[1:]))


def test_scores_need_no_other_columns_and_training_skips_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60) + ["vequmol"] * (3 * (i % 3 == 0))), rng.choice("ab"), rng.choice("xyz"), i) for i in range(300)]
    rows += [(i, " ".join(words(rng, 5000)), "a", "x", 0) for i in range(300, 303)] + [(7, "another text", "b", "y", 0)] * 200
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0 and r[0] < 300)) for r in rows], "doc_id bigint, toxic int")
    got = sorted(toxicity.toxicity(docs, labels, most_chars=60_000).collect(), key=repr)
    bare = sorted(toxicity.toxicity(docs.select("doc_id", "text"), labels, most_chars=60_000).collect(), key=repr)
    assert got == bare and len({r.score for r in got}) > 20
    found = [r.predicted for r in got if r.doc_id % 3 == 0 and r.doc_id < 300]
    assert sum(found) > 0.5 * len(found)


def test_features_are_savings_of_whole_windows():
    """Window lengths by the library itself, with the dictionaries' own bytes in front."""
    import zstandard

    rng = random.Random(2)
    rows = [(" ".join(words(rng, 60) + ["idiotic"] * (3 * (i % 2))), i % 2) for i in range(300)]
    model = toxicity.fit(rows)
    text = " ".join(words(rng, 300) + ["idiotic"] * 5 + words(rng, 40))
    size = lambda content, w: len(zstandard.ZstdCompressor(
        level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))
    saved = []
    for width in model.window_bytes:
        tokens, window = text.lower().encode().split(b" "), b""
        for i, word in enumerate(tokens):
            window += (b" " if window else b"") + word
            # From the second window on the space before it counts.
            if len(window) + (i + 1 > len(window.split())) >= width or i + 1 == len(tokens):
                saved.append(size(model.ordinary, b" " + window + b" ") - size(model.ordinary + model.toxic, b" " + window + b" "))
                window = b""
    over = [sum(max(0, s - k) for s in saved) for k in (1, 2)]
    n = 3 + len(saved)
    want = [1, 10 * over[0] / n, 10 * over[1] / n, np.log1p(over[1]), max(saved) / 5, np.log(n)]
    assert toxicity.Scorer(model).features(text) == pytest.approx(want)


def test_windows_cover_the_text():
    text = " ".join(words(random.Random(1), 300)) + " " + "y" * 1000
    parts = [w.strip() for w in toxicity.windows(text, 48)]
    assert b"".join(p.replace(b" ", b"") for p in parts) == text.replace(" ", "").encode()
    assert max(map(len, parts)) <= 4 * 48


# --- personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end()))
    return sorted(out)


CARD = "4539578763621486"


def personal_texts():
    rng = random.Random(9)
    texts = []
    for i in range(160):
        parts = words(rng, 12)
        parts.insert(4, rng.choice([
            f"a.b{i}@mail{i % 7}.example.com", f"{i}.1.2.{i}", f"{i % 9}.300.2.3", CARD, "4539578763621487", f"+1 (0{i % 10}7) 555-{1000 + i}",
            "+1 23 4", "no data",
        ]))
        texts.append((i, " ".join(parts)))
    return texts


def test_personal_data_base_and_added(spark):
    hard = [
        (500, None), (501, ""), (None, "x@y.zz @ a@b a@b.c@d.e a@b.c_x@d.e"), (502, "1.2.3.4.5.6.7.8 000255.0.0.1 1.2.3.999999999999"),
        (503, f"é😀 {CARD} {CARD}"), (504, "+1 (843) 555-7672 170.106.47.218 end"), (505, "9" * 30_000), (506, "1 " * 20_000),
        (507, "ab" * 50_000 + "@"), (508, "a@b.c " * 300), (508, "a@b.c " * 300), (509, "+" * 20 + "1-" * 40),
    ]
    texts = personal_texts() + hard
    got = pii.personal_data(docs_of(spark, texts)).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for doc, text in texts:
        want = base_spans(text)
        for r in by_id[doc]:
            assert [tuple(s) for s in r.base] == want
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == no for _, k, _ in want) for no in range(4)]
            spans = [tuple(s) for s in r.spans]
            assert set(want) <= set(spans) and spans == sorted(spans)
    assert len(by_id[508]) == 2
    assert [tuple(s) for s in by_id[503][0].spans] == [(3, 2, 19), (20, 2, 36)]
    assert [tuple(s) for s in by_id[504][0].spans] == [(0, 3, 17), (18, 1, 32)]
    for doc, text in texts[:160]:
        assert [tuple(s) for s in by_id[doc][0].spans] == base_spans(text)
    assert pii.personal_data(docs_of(spark, texts).where("doc_id > 999")).count() == 0


def test_redaction(spark):
    texts = personal_texts() + [(900, None), (901, f"é {CARD}."), (902, "x a@b.cc")]
    docs = docs_of(spark, texts)
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert clean[900].text is None
    assert clean[901].text == "é [CARD]." and clean[901].n_chars == len("é [CARD].")
    assert clean[902].text == "x [EMAIL]"
    for doc, text in texts[:160]:
        assert not base_spans(clean[doc].text)
        assert (clean[doc].text == text) == (not base_spans(text))


# --- mixing


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 100}) == pytest.approx({"a": 200, "b": 200 / 3, "c": 400 / 3, None: 200})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def cheapest(quotas, sizes, epochs):
    """All ways to route, by brute force: the most words, then the least cost."""
    arcs = [(s, p) for p in sizes for s in p]
    best = None
    for amounts in itertools.product(*[range(min(quotas[s], epochs * sizes[p]) + 1) for s, p in arcs]):
        out, into = collections.Counter(), collections.Counter()
        for (s, p), a in zip(arcs, amounts):
            out[s] += a
            into[p] += a
        if any(out[s] > quotas[s] for s in quotas) or any(into[p] > epochs * sizes[p] for p in sizes):
            continue
        cost = sum(sum(2 * e - 1 for e in range(1, epochs + 1) for _ in range(max(0, min(sizes[p], into[p] - (e - 1) * sizes[p])))) for p in sizes)
        key = (-sum(amounts), cost)
        best = key if best is None else min(best, key)
    return best


def test_route_is_the_cheapest_flow():
    quotas, sizes = {"a": 4, "b": 3, "c": 2}, {("a",): 2, ("a", "b"): 2, ("b", "c"): 1, ("c",): 0}
    taken = flow.route(quotas, sizes, 2)
    cost = sum(sum(2 * e - 1 for e in (1, 2) for _ in range(max(0, min(sizes[p], taken[p] - (e - 1) * sizes[p])))) for p in sizes)
    assert (-sum(taken.values()), cost) == cheapest(quotas, sizes, 2)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randint(0, 40))), "en", rng.choice(["a", "b", "b", "b", "é", None]), 1) for i in range(800)]
    docs = frame(spark, rows)
    got = mixing.mixed_counts(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text))
    goal = mixing.targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id][1])) and r.source == rows[r.doc_id][3]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= 5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_counts(docs.repartition(5)).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect() if WORD.search(r.text))
    assert copies == {r.doc_id: r.taken // r["size"] for r in got if r.taken}


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "q w e r", ""), (4, "m n", "null"), (4, "m n", "null"), (5, "é u", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("x")).withColumn("times", F.lit(9))
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mixed_counts(docs).collect()), key=repr)
    assert [g[:4] for g in got] == sorted([
        (1, 3, 5, 8.625), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (None, 4, 4, 8.0), (4, 2, 4, 2.875), (4, 2, 4, 2.875), (5, 2, 5, 8.625)], key=repr)
    assert all(g[4] <= 2 * g[1] for g in got)
    assert mixing.mixed_counts(docs.where("doc_id > 9")).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_overlapping_sources_share_documents(spark):
    rows = [(i, "w " * 10, ["a"] if i < 10 else ["a", "b"]) for i in range(20)] + [(99, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, members array<string>")
    mix, _ = mixing.plan_mix(docs, F.col("members"), share=0.9, weights=(1,))
    whole = {p: t for p, t, *_ in mix.picks}
    assert set(whole) == {"[]", '["a"]', '["a","b"]'} and mix.sources["b"][0] == 100


# --- SentencePiece


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rng = random.Random(4)
    texts = ["", " ", "a  b", "Hello\tworld\n\nfoo ", "ﬁ ① é", "<s> a <0x41>", "  lead", "\x00a\x0bb", "日本語 😀", "a" * 700, " " * 37 + "x   ", "#### !!!!"]
    texts += ["".join(rng.choice([*SYLLABLES, " ", "  ", ",", "é", "\n", "the ", "9"]) for _ in range(60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (5000, None), (5001, "x y"), (5001, "x y"), (5002, "▁x")]
    encoded = sentencepiece.encode(docs_of(spark, rows))
    got = encoded.collect()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == model.encode(text) and r.n_pieces == len(r.ids)
        assert r.round_trip == ("▁" not in text)
    assert len(got) == len(rows)
    back = {r.doc_id: r.text for r in sentencepiece.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert sentencepiece.encode(docs_of(spark, rows).where("doc_id > 9999")).count() == 0


def test_bounded_cache_changes_nothing():
    from framewarden.llm.piece_transducer import PieceModel, Transducer

    model = PieceModel.parse(open(sentencepiece.MODEL, "rb").read())
    text = " ".join(words(random.Random(8), 400))
    assert Transducer(model, 5).encode(text) == Transducer(model).encode(text)


# --- quality


def counts_of(text):
    text = text or ""
    w, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [(None, None), (1, ""), (2, "a b a b a b"), (3, "x\nx\n\n \n x\nx"), (4, "é#  $\x0b%"), (5, "a " * 5000), (6, "a b c"), (6, "a b c")]
    texts += [(10 + i, rng.choice(" \n").join(rng.choices(["a", "b#", "c", "d", "é"], k=rng.randint(0, 90)))) for i in range(120)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.quality(docs_of(spark, texts), labels).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr)
    assert got == sorted(((i, *counts_of(t)) for i, t in texts), key=repr)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.quality(docs_of(spark, texts).where("doc_id > 999"), labels).count() == 0


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.5), (30, 0.01), (200, 0.1), (57, 0.93)):
        exact = Fraction(0)
        for k in range(n + 1):
            exact += math.comb(n, k) * Fraction(p) ** k * (1 - Fraction(p)) ** (n - k)
            assert quality.binomial_cdf(k, n, p) == pytest.approx(float(exact), rel=1e-9, abs=1e-14)


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(3000):
        good = i % 3 > 0
        text = words(rng, 60)
        for j in range(rng.choice((0, 0, 0, 1)) if good else 20):
            text[j] += "###"
        texts.append((i, " ".join(text)))
        labels.append((i, int(good)))
    measured = quality.measures(docs_of(spark, texts))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    (stratum, cutoffs), = quality.chosen_cutoffs(measured, known).collect()
    assert stratum == "en" and tuple(cutoffs) in quality.steps_of(quality.RULES)
    rows = quality.quality(docs_of(spark, texts), known).collect()
    truth = dict(labels)
    assert sum(not r.kept for r in rows if truth[r.doc_id]) <= 0.02 * 2000
    assert sum(r.kept for r in rows if not truth[r.doc_id]) == 0
    few = quality.chosen_cutoffs(measured.where("doc_id < 60"), known).collect()
    assert [r.cutoffs for r in few] == [None]
    # A text counts once, however many rows repeat it.
    again = measured.where("doc_id < 60").crossJoin(spark.range(50)).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("id")).drop("id")
    more = spark.createDataFrame([(i + 1000 * k, 1) for i in range(60) for k in range(50)], "doc_id bigint, quality int")
    assert [r.cutoffs for r in quality.chosen_cutoffs(again, more).collect()] == [None]


def plain_cutoffs(rows, most_rejected, level):
    """``rows``: stratum -> list of measures of distinct good texts."""
    steps = quality.steps_of(quality.RULES)
    least = math.ceil(math.log(level / len(rows)) / math.log1p(-most_rejected))
    pools = collections.defaultdict(list)
    for name, found in rows.items():
        pools[name if len(found) >= least else None] += found

    def passed(own, part):
        unit = 10 ** max(0, len(str(len(own))) - 3)
        for j, cut in enumerate(steps):
            k = sum(any(m > c for m, c in zip(measures, cut)) for measures in own)
            if quality.binomial_cdf(k, len(own) // unit * unit, most_rejected) > part:
                return j
        return len(steps)

    taken = {p: passed(own, level / len(pools)) for p, own in pools.items()}
    done = sum(j == len(steps) for j in taken.values())
    if 0 < done < len(pools):
        taken = {p: passed(own, level / (len(pools) - done)) for p, own in pools.items()}
    at = {n: taken[n if len(found) >= least else None] for n, found in rows.items()}
    return {n: list(steps[j - 1]) if j else None for n, j in at.items()}


def test_cutoffs_of_many_strata_equal_a_plain_search(spark):
    rng = random.Random(11)
    sizes = {"big": 1500, "clean": 1200, "mid": 400, **{f"s{i}": 20 for i in range(30)}}
    rows, plain = [], collections.defaultdict(list)
    for name, n in sizes.items():
        for i in range(n):
            bad = 0 if name == "clean" else rng.choice([0] * 60 + [1, 5, 20])
            row = (len(rows), name, len(rows), 100, 700, 7 * bad, 0, 0 if name == "clean" else rng.choice([0, 0, 0, 3]), 10)
            rows.append(row)
            plain[name].append((row[5] / 700, 0.0, row[7] / 100, 7.0))
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, mark long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    known = measured.select("doc_id", F.lit(1).alias("quality"))
    for share in (0.02, 0.05):
        got = {r.stratum: r.cutoffs for r in quality.chosen_cutoffs(measured, known, most_rejected=share).collect()}
        assert got == plain_cutoffs(plain, share, 0.05)
        assert got["clean"] == list(quality.steps_of(quality.RULES)[-1]) and got["s1"] == got["s2"]


# --- fingerprints


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(11)
    texts = [(i * 3, "\n".join(" ".join(words(rng, rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    texts += [(None, "é😀 x"), (1000, None), (1003, "a b\nc d"), (1006, "c d\na b")]
    order = sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0), reverse=True)
    got = {r.doc_id: r for r in multiset_hash.fingerprints(docs_of(spark, texts)).collect()}
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert got[1003].fingerprint == got[1006].fingerprint  # order of paragraphs
    distinct = collections.defaultdict(set)
    for doc, text in texts:
        distinct[got[doc].fingerprint].add(tuple(sorted(p for p in (text or "").split("\n") if p)))
    assert all(len(v) == 1 for v in distinct.values())
    assert multiset_hash.fingerprints(docs_of(spark, texts).where("doc_id > 9999")).count() == 0


def lanes(print_):
    exact = multiset_hash.EXACT * 8
    return [int(print_[i : i + 8], 16) for i in range(0, exact, 8)], [int(print_[i : i + 4], 16) for i in range(exact, len(print_), 4)]


def test_fingerprints_add_and_subtract(spark):
    texts = [(1, "the first one"), (2, "and a second\nthird line"), (3, "third line\nthe first one\nand a second"), (4, "x"), (4, "x"), (5, "y")]
    got = collections.defaultdict(list)
    for r in multiset_hash.fingerprints(docs_of(spark, texts)).collect():
        got[r.doc_id].append(r.fingerprint)
    (a, b), (c, d), (e, f) = (lanes(got[i][0]) for i in (1, 2, 3))
    assert [(x + y) % 2**32 for x, y in zip(a, c)] == e and [(x + y) % 2**16 for x, y in zip(b, d)] == f
    assert len(got[4]) == 2 and len(set(got[4])) == 1


def test_next_row_across_chunks(spark):
    rows = spark.range(0, 500).select(F.expr("id * id").alias("id"), F.col("id").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    for size in (7, 1000):
        original = multiset_hash.chunked
        try:
            multiset_hash.chunked = lambda r, n=size: original(r, n, 8, 4)
            got = {r.id: r.next_id for r in multiset_hash.with_next(rows).collect()}
        finally:
            multiset_hash.chunked = original
        assert got == {i * i: (i - 1) ** 2 if i else 499 * 499 for i in range(500)}


# --- licences


def test_licenses_are_inherited_from_the_nearest_folder(spark):
    mit, apache = "Released under the MIT License.", "code\nLicensed under the Apache License, Version 2.0.\ncode"
    rows = [
        (1, "p/LICENSE", mit), (2, "p/a/b/x.c", "no notice"), (3, "p/a/LICENSE.txt", apache), (4, "p/a/b/y.c", None),
        (5, "p/z.c", ""), (6, "q/z.c", "x"), (7, "p/a/own.c", "this is\n" + mit + "\n" + "x " * 5000), (8, None, mit),
        (9, "p/a/b/x.c", "no notice"), (10, "license free talk", "free of any licence talk and other words of no weight at all"), (11, "pa/z", "x"),
    ]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("license", F.lit(0)).withColumn("folder", F.lit(0))
    got = {r.doc_id: (r.license, r.origin, r.from_path) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "p/a/LICENSE.txt"), 3: ("Apache-2.0", "own", None),
        4: ("Apache-2.0", "inherited", "p/a/LICENSE.txt"), 5: ("MIT", "inherited", "p/LICENSE"), 6: (None, "none", None),
        7: ("MIT", "own", None), 8: (None, "none", None), 9: ("Apache-2.0", "inherited", "p/a/LICENSE.txt"), 10: (None, "none", None),
        11: (None, "none", None),
    }
    assert licenses.scan_licenses(files.where("doc_id > 99")).count() == 0


def test_wrapped_headers_and_full_texts(spark):
    full = dict(licenses.full_texts())
    gpl = (
        "#!/bin/sh\n# Copyright (C) 2020 Some One\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the"
        " GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n"
        "#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY.\n\nrun me\n"
    )
    lgpl = gpl.format(3).replace("General Public License as", "Lesser General Public License as").replace("# ", "// ")
    mpl = (
        "/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy of the MPL was not distributed with this\r\n"
        " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\r\n\r\nint x;\r\n"
    )
    commented = "".join(f" * {line}".rstrip() + "\n" for line in full["BSD-3-Clause"].split("\n"))
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 Some One\n\n" + full["MIT"].split("\n\n", 1)[1]), (2, "a/x.c", "int x;"), (3, "b/COPYING", full["GPL-3.0"]),
        (4, "b/y.c", None), (5, "c/LICENSE.txt", "Copyright 2020, Some One\nAll rights reserved.\n\n" + full["BSD-3-Clause"]),
        (6, "d/LICENSE", full["BSD-2-Clause"]), (7, "e/g3.sh", gpl.format(3)), (8, "e/g2.sh", gpl.format(2)), (9, "e/l.c", lgpl), (10, "e/m.c", mpl),
        (11, "e/b.c", "/*\n * Copyright 2020\n *\n" + commented + " */\nint x;"), (12, "f/COPYING", full["GPL-2.0"]), (13, "g/LICENSE", full["Apache-2.0"]),
        (14, "e/none.c", "license talk of\nmany lines that\ngrant nothing"),
    ]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: ("BSD-3-Clause", "own"), 6: ("BSD-2-Clause", "own"),
        7: ("GPL-3.0", "own"), 8: ("GPL-2.0", "own"), 9: ("LGPL-3.0", "own"), 10: ("MPL-2.0", "own"), 11: ("BSD-3-Clause", "own"), 12: ("GPL-2.0", "own"),
        13: ("Apache-2.0", "own"), 14: (None, "none"),
    }


def test_hash_helpers():
    from framewarden.llm.shingles import shingle_sets

    data = "A b\tc d e f  Z".encode() + b"" + b"a B c d e"
    offsets = np.array([0, 14, 14, len(data)])
    one, none, two = shingle_sets(np.frombuffer(data, np.uint8), offsets)
    assert len(one) == 3 and not len(none) and set(two) < set(one)

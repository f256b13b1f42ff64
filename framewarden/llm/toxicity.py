"""Toxicity by compression distance.

zstandard trains two dictionaries: ``ordinary`` on text labelled 0 and ``toxic``
on excerpts of text labelled 1.  Toxic text as a whole is mostly ordinary words,
and so would its dictionary be; the excerpts are the words and word pairs that
recur in toxic texts and are proven to be rare in ordinary ones, each time they
occur.  Every window of a text is compressed twice, primed with ordinary text
alone and with ordinary plus toxic text; the bytes the toxic dictionary saves are
the window's distance.  A logistic curve fitted on other labelled rows turns a
text's savings into a score.  Scores and training see nothing but texts and labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, written

GRAM = 5
#: Windows of several sizes: a match gains differently next to other words.
WINDOW_BYTES = (24, 48, 96)
LEVEL = 3
#: A unit counts from so many toxic texts on, if it is so many times as frequent there, with so large a share of chance finds.
SUPPORT, LEAST_RATIO, FALSE_SHARE = 3, 25, 0.02


#: Places of the rough count of units.
ROUGH = 1 << 22
#: Segment and run lengths of the toxic dictionary's training, and its least size.
TOXIC_K, TOXIC_D, TOXIC_BYTES = 24, 8, 8192
#: Power of an excerpt's count, below 1 so that rare excerpts have their share.
EVEN = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window_bytes: tuple[int, ...] = WINDOW_BYTES


def grams(piece: bytes) -> set[bytes]:
    return {piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1)}


def windows(text: str, size: int) -> Iterator[bytes]:
    """The whole text in windows of at least ``size`` bytes that end at a space.

    A window without a space ends after ``4 * size`` bytes, so a text of one
    endless word stays bounded too.
    """
    data = b" ".join(text.lower().encode().split())
    at, end = 0, len(data)
    while at < end:
        cut = data.find(b" ", at + size, at + 4 * size)
        if cut < 0:
            cut = min(end, at + 4 * size)
        yield b" %b " % data[at:cut].strip()
        at = cut


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The dictionary zstandard trains on samples; too few to train on serve as they are, the last ones last."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(reversed(samples)))[:size] if samples else b""


def ordinary_dictionary(texts: list[str], size: int) -> bytes:
    return trained([t.lower().encode() for t in texts], size, 64, 6)


def word_grams(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """The byte runs of words, each with a hash of the words beside it."""
    for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
        beside = hash((before, after))
        for g in grams(b" %b " % word):
            yield g, beside


def word_pairs(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """The pairs of neighbouring words, each with a hash of the words beside it."""
    for before, one, two, after in zip([b"", *words], words, words[1:], [*words[2:], b""]):
        yield b" %b %b " % (one, two), hash((before, after))


def chance(n: int, m: int, toxic: int, ordinary: int) -> float:
    """How likely ``n`` or more of ``n + m`` texts are among the ``toxic`` ones if all texts are alike."""
    of = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    whole = of(toxic + ordinary, n + m)
    return sum(math.exp(of(toxic, k) + of(ordinary, n + m - k) - whole) for k in range(max(n, n + m - ordinary), min(toxic, n + m) + 1))


def telling(toxic: list[str], ordinary: list[str], units: Callable[[list[bytes]], Iterator[tuple[bytes, int]]]) -> set[bytes]:
    """Units that recur in toxic texts and hardly occur in ordinary ones.

    Units are taken as long as no more than ``FALSE_SHARE`` of them are expected
    to be there by chance.  Texts copied from each other are no evidence: a unit
    counts once for the same neighbours.
    """
    support = max(2, min(SUPPORT, len(toxic) // 10))
    words = lambda texts: (t.lower().encode().split() for t in texts)
    # Most units are there once: a rough count over hashes spares them a place among the exact ones.
    rough = np.zeros(ROUGH, dtype=np.int32)
    for w in words(toxic):
        places = np.array([hash(u) % ROUGH for u in {u for u, _ in units(w)}], dtype=np.int64)
        np.add.at(rough, places, 1)
    frequent = (rough >= support).tobytes()
    bad = Counter(u for w in words(toxic) for u in {u for u, _ in units(w) if frequent[hash(u) % ROUGH]})
    bad = Counter({u: n for u, n in bad.items() if n >= support})
    good = Counter(u for w in words(ordinary) for u in {u for u, _ in units(w) if u in bad})
    t, o = len(toxic), len(ordinary)
    rare: dict[bytes, set] = {u: set() for u, n in bad.items() if n * (o + 1) > LEAST_RATIO * good[u] * t}
    for w in words(toxic):
        for u, beside in units(w):
            if u in rare:
                rare[u].add(beside)
    tried = len(bad)
    chances = sorted((chance(min(bad[u], len(beside)), good[u], t, o), u) for u, beside in rare.items())
    last = max((k for k, (p, _) in enumerate(chances, 1) if p * tried <= FALSE_SHARE * k), default=0)
    return {u for _, u in chances[:last]}


def excerpts(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """All occurrences in toxic texts of words with a telling byte run, and of telling pairs of words."""
    runs, pairs = telling(toxic, ordinary, word_grams), telling(toxic, ordinary, word_pairs)
    out = []
    for text in toxic:
        words = text.lower().encode().split()
        for one, two in zip(words, [*words[1:], b""]):
            word, pair = b" %b " % one, b" %b %b " % (one, two)
            out += [x for x, known in ((word, any(g in runs for g in grams(word))), (pair, pair in pairs)) if known]
    return out


def toxic_dictionary(toxic: list[str], ordinary: list[str]) -> bytes:
    """The dictionaries zstandard trains on the excerpts, one after the other until none is left out.

    Training leaves out what is rare beside the rest, such as the words of a
    small language; the next dictionary is trained on that alone and goes in
    front.  Samples come in rounds: each excerpt is in as many of the first ones
    as a power of its count says.
    """
    left = Counter(excerpts(toxic, ordinary))
    content = b""
    while left:
        rounds = {x: max(1, round(n**EVEN)) for x, n in left.items()}
        samples = [x for r in range(max(rounds.values())) for x in sorted(rounds) if rounds[x] > r]
        content = trained(samples, max(TOXIC_BYTES, 2 * sum(map(len, left))), TOXIC_K, TOXIC_D) + content
        missed = Counter({x: n for x, n in left.items() if x.strip() not in content})
        if len(missed) == len(left):  # nothing that training could hold: they serve as they are
            return b" ".join(sorted(missed, key=lambda x: (missed[x], x))) + content
        left = missed
    return content


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.plain = compressor(model.ordinary)
        self.primed = compressor(model.ordinary + model.toxic)

    def features(self, text: str | None) -> np.ndarray:
        plain, primed = self.plain.compress, self.primed.compress
        saved = [len(plain(w)) - len(primed(w)) for size in self.model.window_bytes for w in windows(text or "", size)]
        over1 = sum(s - 1 for s in saved if s > 1)
        over2 = sum(s - 2 for s in saved if s > 2)
        n = 3 + len(saved)
        return np.array([1.0, 10 * over1 / n, 10 * over2 / n, np.log1p(over2), max(saved, default=0) / 5, np.log(n)])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.weights))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Newton's method with a small ridge; the intercept is free."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple], ordinary_bytes: int = 8192) -> ToxicityModel:
    """Model of ``(text, 0 or 1)`` rows; every third row calibrates, the others train the dictionaries.

    Without rows of both kinds every text scores 0.
    """
    train = [r for i, r in enumerate(rows) if i % 3]
    toxic, ordinary = ([t for t, y in train if y == kind] for kind in (1, 0))
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", (-30.0, 0, 0, 0, 0, 0))
    model = ToxicityModel(ordinary_dictionary(ordinary, ordinary_bytes), toxic_dictionary(toxic, ordinary), (0.0,) * 6)
    scorer = Scorer(model)
    held = [r for i, r in enumerate(rows) if i % 3 == 0]
    if len({y for _, y in held}) < 2:
        held = rows
    x = np.array([scorer.features(t) for t, _ in held])
    y = np.array([y for _, y in held], dtype=float)
    return ToxicityModel(model.ordinary, model.toxic, tuple(map(float, logistic(x, y))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, most_rows: int = 3000, most_chars: int = 12_000_000
) -> ToxicityModel:
    """Fit on at most ``most_rows`` rows and ``most_chars`` characters of text of each label.

    The rows are those with the smallest hash of their id, outside the held-out
    fold; a text that would go beyond the characters left is passed over.  Labels
    other than 0 and 1, null ids and null texts are left out; an id with both
    labels is toxic, and of an id's texts that with the smallest hash counts.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [
        (r.doc_id, kind, k) for kind in (0, 1)
        for k, r in enumerate(known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most_rows).collect())
    ]
    chosen = bounded_rows(spark, ids, "_id bigint, _toxic int, _order int", 2 * most_rows)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    picked = texts.join(chosen, F.col("_doc") == F.col("_id")).groupBy("_id", "_toxic", "_order").agg(
        F.min_by("_text", F.xxhash64("_text")).alias("_text")
    )
    picked = written(picked, "toxicity-texts")
    left, within = [most_chars, most_chars], []
    for r in sorted(picked.select("_id", "_toxic", "_order", F.length("_text").alias("_n")).collect(), key=lambda r: (r._order, r._toxic)):
        if r._n <= left[r._toxic]:
            left[r._toxic] -= r._n
            within.append(r._id)
    kept = picked.join(bounded_rows(spark, [(i,) for i in within], "_kept bigint", 2 * most_rows), F.col("_id") == F.col("_kept"))
    rows = sorted(kept.collect(), key=lambda r: (r._order, r._toxic))
    return fit([(r._text, r._toxic) for r in rows])


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Score of a text from 0 to 1; a null or empty text is scored as one without windows."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            # One text at a time leaves the Arrow buffer: a batch of long texts is not there twice.
            scores = pa.array([scorer.score(t.as_py()) for t in batch], pa.float64())
            yield scores
            del batch, scores
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, T.DoubleType(), F.ArrowUDFType.SCALAR_ITER)(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Repeated rows are scored each; a null id is never held out; an empty table
    gives an empty one; columns besides ``doc_id`` and ``text`` are not read.
    """
    model = train_toxicity(docs, labels, **bounds)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """The rows of ``docs``, all their columns, that score below ``threshold``."""
    model = train_toxicity(docs, labels, **bounds)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, toxicity_score(model, F.col("text"))).where(F.col(name) < threshold).drop(name)

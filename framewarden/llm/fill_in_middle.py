"""Fill-in-middle by displacement scatter.

A batch of texts is one array of bytes.  A scan over it finds the tokens and so
the cuts of every text; a difference array then holds, at the start of each
prefix, middle and suffix, by how much the shift of its bytes to their places in
the outputs changes.  Its cumulative sum is the shift of every byte, and one
numpy scatter builds all outputs of the batch.  Restoring finds the marks in the
outputs and gathers the bytes back by the inverse shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

# The marks of prefix, suffix and middle, and the forms.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
_OPEN, _CLOSE = ord("<"), ord(">")
_P, _S, _M = (ord(m[1]) for m in MARKS)
MARK_BYTES = 3
BLOCK_BYTES = 1 << 20


def byte_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` of runs of texts of about ``most`` bytes, one text at least; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(len(texts), max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a token begins: a run of letters A-Z and a-z, or any other code point."""
    lower = data | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(starts)


def marks_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the text that each is in."""
    name = data[1:-1]
    at = np.flatnonzero((data[:-2] == _OPEN) & (data[2:] == _CLOSE) & ((name == _P) | (name == _S) | (name == _M)))
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK_BYTES <= offsets[owner + 1]
    return at[inside], owner[inside]


def displaced(starts: list[np.ndarray], shifts: list[np.ndarray], length: int) -> np.ndarray:
    """Place of every one of ``length`` bytes after its stretch's shift.

    ``starts`` and ``shifts`` hold the first, second, ... stretch of every text;
    a stretch reaches to the next one.  Stretches may be empty.
    """
    change = np.zeros(length + 1, dtype=np.int64)
    steps = np.diff(np.stack(shifts, axis=1).ravel(), prepend=0)
    np.add.at(change, np.stack(starts, axis=1).ravel(), steps)
    places = np.cumsum(change[:-1])
    places += np.arange(length)
    return places


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def cut_and_scatter(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, plain_from: int, spm_below: int) -> dict[str, np.ndarray]:
    """Outputs of a batch of texts; ``h`` holds the four numbers of each text in its rows."""
    begin, end = offsets[:-1], offsets[1:]
    tokens = token_starts(data, offsets)
    first = np.searchsorted(tokens, offsets)
    n = np.diff(first)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    reach = np.append(tokens, len(data))
    cut = lambda k: np.where(k < n, reach[first[:-1] + np.minimum(k, n)], end)
    a, b = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    marked = np.zeros(len(n), dtype=bool)
    marked[marks_in(data, offsets)[1]] = True
    form = np.where(h[:, 3] % 100 < spm_below, SPM, PSM)
    form[(begin == end) | marked | (h[:, 2] % 100 >= plain_from)] = PLAIN
    formed, swapped = form != PLAIN, form == SPM

    sizes = end - begin + np.where(formed, len(MARKS) * MARK_BYTES, 0)
    out = starts_of(sizes)
    head = np.where(swapped, end - b, a - begin)  # bytes between the first two marks
    second = out[:-1] + MARK_BYTES + head
    third = second + MARK_BYTES + np.where(swapped, a - begin, end - b)
    to_prefix = np.where(swapped, second, out[:-1]) + MARK_BYTES
    to_suffix = np.where(swapped, out[:-1], second) + MARK_BYTES
    still = out[:-1] - begin
    shifts = [np.where(formed, to - at, still) for to, at in ((to_prefix, begin), (third + MARK_BYTES, a), (to_suffix, b))]
    built = np.empty(int(out[-1]), dtype=np.uint8)
    built[displaced([begin, a, b], shifts, len(data))] = data
    for at, name in ((out[:-1], np.where(swapped, _S, _P)), (second, np.where(swapped, _P, _S)), (third, np.full(len(n), _M))):
        built[at[formed]], built[at[formed] + 1], built[at[formed] + 2] = _OPEN, name[formed], _CLOSE
    points = starts_of((data & 0xC0) != 0x80)
    return {
        "n": n, "form": form, "prefix_chars": points[a] - points[begin], "middle_chars": points[b] - points[a],
        "data": built, "offsets": out,
    }


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, offsets, whole)`` of the texts behind outputs; ``whole`` is false where marks are missing."""
    begin, end = offsets[:-1], offsets[1:]
    at, owner = marks_in(data, offsets)
    keep = form[owner] != PLAIN
    at, owner = at[keep], owner[keep]
    count = np.bincount(owner, minlength=len(form))
    whole = (form == PLAIN) | (count == len(MARKS))
    formed = (form != PLAIN) & whole
    places = np.zeros((len(form), len(MARKS)), dtype=np.int64)
    places[formed] = at[whole[owner]].reshape(-1, len(MARKS))
    first, second, third = places.T
    swapped = form == SPM
    sizes = np.where(whole, end - begin, 0) - np.where(formed, len(MARKS) * MARK_BYTES, 0)
    out = starts_of(sizes)
    p = np.where(formed, np.where(swapped, second, first) + MARK_BYTES, begin)
    p_size = np.where(formed, np.where(swapped, third - second, second - first) - MARK_BYTES, sizes)
    m = np.where(formed, third + MARK_BYTES, begin)
    m_size = np.where(formed, end - m, 0)
    s = np.where(formed, np.where(swapped, first, second) + MARK_BYTES, begin)
    starts = [out[:-1], out[:-1] + p_size, out[:-1] + p_size + m_size]
    shifts = [x - y for x, y in zip((p, m, s), starts, strict=True)]
    return data[displaced(starts, shifts, int(out[-1]))], out, whole


def strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
    return texts if valid is None or valid.all() else pa.compute.if_else(pa.array(valid), texts, pa.scalar(None, pa.string()))


def with_columns(batch: pa.RecordBatch, dropped: tuple[str, ...], **more: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in dropped]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *more.values()], names=[*kept, *more])


def numbers_of(key: Column) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of a string, as unsigned integers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``doc_id, text`` of every row, with ``n, form, prefix_chars, middle_chars, output``.

    A text of ``n`` tokens is cut by two numbers drawn from ``seed`` and its id;
    ``plain`` of 100 texts stay as they are, ``spm`` of 100 others begin with the
    suffix.  Null is an empty text, empty texts and texts with a mark in them
    stay plain, and a null id draws as an empty string.  Rows that repeat are
    transformed each, an empty table gives an empty one, further columns are
    left out.  A text of any length is cut as a whole: a batch holds about
    ``BLOCK_BYTES`` bytes, or one longer text, and some 40 bytes for each of them.
    """
    drawn = numbers_of(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), *[h.alias(f"_h{i}") for i, h in enumerate(drawn)]
    )
    drawn_names = tuple(f"_h{i}" for i in range(4))
    long = T.LongType()
    schema = T.StructType([
        *rows.select("doc_id", "text").schema.fields, T.StructField("n", long), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", long), T.StructField("middle_chars", long), T.StructField("output", T.StringType()),
    ])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in drawn_names], axis=1)
            for at, to, data, offsets in byte_blocks(batch.column("text")):
                x = cut_and_scatter(data, offsets, h[at:to], 100 - plain, spm)
                chars = {c: pa.array(x[c], pa.int64(), mask=x["form"] == PLAIN) for c in ("prefix_chars", "middle_chars")}
                yield with_columns(
                    batch.slice(at, to - at), drawn_names, n=pa.array(x["n"], pa.int64()),
                    form=pa.array(np.array(FORMS, dtype=object)[x["form"]], pa.string()), **chars, output=strings(x["data"], x["offsets"]),
                )

    return rows.mapInArrow(transform, schema)


def restore(outputs: DataFrame) -> DataFrame:
    """Rows with ``form`` and ``output`` as they are, with ``restored``: the text behind the output.

    A null output, an unknown or null form, and an output without the three
    marks of its form restore to null.
    """
    schema = T.StructType([*(f for f in outputs.schema.fields if f.name != "restored"), T.StructField("restored", T.StringType())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = pa.compute.index_in(batch.column("form"), pa.array(FORMS)).fill_null(-1).to_numpy(zero_copy_only=False)
            known = (form >= 0) & batch.column("output").is_valid().to_numpy(zero_copy_only=False)
            form = np.where(known, form, PLAIN)
            for at, to, data, offsets in byte_blocks(batch.column("output")):
                text, ends, whole = gather(data, offsets, form[at:to])
                yield with_columns(batch.slice(at, to - at), ("restored",), restored=strings(text, ends, whole & known[at:to]))

    return outputs.mapInArrow(back, schema)

"""Sets of hashed word shingles, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK_BYTES = 1 << 20
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACE = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
_STEP = _U(0x5851F42D4C957F2D)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts ``data[offsets[i]:offsets[i + 1]]``, and each text's first word.

    Words are runs without space, tab or line characters; A-Z counts as a-z.
    """
    n_texts = len(offsets) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    before |= edge[:-1]
    starts = np.flatnonzero(~space & before)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    after = np.ones(len(data), dtype=bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    ends = np.flatnonzero(~space & after) + 1
    lengths = ends - starts
    low = np.where((data >= 65) & (data <= 90), data + 32, data)[~space]
    at = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(len(low)) - np.repeat(at, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
    hashes = np.add.reduceat(_BYTE[low] * power[place], at)
    return mixed(hashes + lengths.astype(np.uint64)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer than ``WIDTH`` words count as one shingle."""
    words, first = word_hashes(data, offsets)
    n = len(words) - WIDTH + 1
    if n > 0:
        total = words[:n] * _PLACE[0]
        for j in range(1, WIDTH):
            total = total + words[j : j + n] * _PLACE[j]
        total = mixed(total)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= WIDTH:
            out.append(np.unique(total[a : b - WIDTH + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(members: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mixed(members ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64) + _U(len(members))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def sets_of(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sets of the rows from there)`` for blocks of about ``BLOCK_BYTES`` of text; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        to = min(len(texts), max(at + 1, to))
        yield at, shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to

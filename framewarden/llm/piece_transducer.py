"""SentencePiece encoding as the shortest path of a weighted transducer.

Three machines are compiled from a model file.  The normaliser copies every
character, writes a space as the mark U+2581 and puts one mark in front.  The
byte fallback writes a character that is no piece as its UTF-8 bytes.  The piece
machine has one state for each piece: the piece read last.  From a piece ``a``
an arc reads a piece ``b`` with weight 0 if merging the characters of ``a b`` in
order of the merge scores gives just these two pieces, and has infinite weight
otherwise.  Pieces agree in this pairwise sense along a path exactly if the path
is the result of merging the whole string, so composed with an input the finite
path is the encoding, and the tropical shortest path finds it position by
position.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, BYTE = 1, 6  # types of pieces in the model format
INFINITE = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    """Pieces of a BPE model with byte fallback: what the machines are compiled from."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        import struct

        pieces, scores, kinds = [], [], []
        model_type, rules, prefix, strip = 1, b"", True, True
        for no, value in fields(data):
            if no == 1:
                own = dict(fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif no == 2:
                model_type = dict(fields(value)).get(3, 1)
            elif no == 3:
                own = dict(fields(value))
                rules, prefix, strip = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if model_type != 2 or rules or strip or BYTE not in kinds:
            raise ValueError("only BPE models with byte fallback that keep characters and white space as they are")
        return PieceModel(tuple(pieces), tuple(scores), tuple(kinds), prefix)


@dataclass
class Transducer:
    """The compiled machines; caches are bounded."""

    model: PieceModel
    most_cached: int = 1_000_000
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        m = self.model
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        merged = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-m.scores[self.ids[p]], self.ids[p]))
        #: Order of merging; single characters come before all.
        self.rank = {p: 0 for p in self.ids if len(p) == 1} | {p: i for i, p in enumerate(merged, 1)}
        #: Pairs of characters side by side in a piece: no piece reaches across any other border.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: What pieces end with: a longer stretch than these is not looked at.
        self.tails = {p[i:] for p in self.ids for i in range(1, len(p))}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.paths: dict[str, bytes] = {}
        # Pieces no merge makes are never read.
        self.ids = {p: i for p, i in self.ids.items() if self.stands(p)}
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b""
            for p, k in zip(m.pieces, m.kinds)
        ]

    def merge(self, text: str) -> list[str]:
        """Merge neighbours in order of their scores, the leftmost first of equals: the definition."""
        cells: list[str | None] = list(text)
        after = list(range(1, len(cells) + 1))
        before = list(range(-1, len(cells) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(cells)
            if i >= 0 and j < len(cells):
                both = cells[i] + cells[j]
                if both in self.ids:
                    heapq.heappush(heap, (-self.model.scores[self.ids[both]], i, both))

        for i in range(len(cells)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if cells[i] is None or j >= len(cells) or cells[j] is None or cells[i] + cells[j] != both:
                continue
            cells[i], cells[j] = both, None
            after[i] = after[j]
            if after[i] < len(cells):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [c for c in cells if c is not None]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; none for a character or a piece no merge makes."""
        if piece not in self.parts:
            found = None
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in self.ids and b in self.ids and self.stands(a) and self.stands(b) and self.pair(a, b, self.rank[piece]):
                    found = a, b
                    break
            self.parts[piece] = found
        return self.parts[piece]

    def stands(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def pair(self, a: str, b: str, under: float = INFINITE) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before theirs, or before rank ``under``.

        Both are taken apart, the piece merged last first; a pair of pieces at
        the border merges if that is due before the side taken apart was made.
        """
        if under == INFINITE and (a, b) in self.agree:
            return self.agree[a, b]
        x, y, limit, good = a, b, under, True
        rank, ids = self.rank, self.ids
        while True:
            both = x + y
            if both in ids and rank[both] < limit and not (x is a and y is b and under != INFINITE):
                good = False
                break
            if len(x) == 1 and len(y) == 1:
                break
            if rank[x] > rank[y] or len(y) == 1:
                limit = rank[x]
                x = self.split(x)[1]
            else:
                limit = rank[y] + 1
                y = self.split(y)[0]
        if under == INFINITE:
            if len(self.agree) >= 4 * self.most_cached:
                self.agree.clear()
            self.agree[a, b] = good
        return good

    def shortest(self, text: str) -> list[str]:
        """Pieces of the shortest path for ``text``, whose characters all are pieces.

        ``weight[i]`` and ``last[i]`` are the state before position ``i``; only
        one piece ending there has a finite weight.
        """
        agree, pair, ids, tails = self.agree.get, self.pair, self.ids, self.tails
        weight = [0.0] + [INFINITE] * len(text)
        last: list[str | None] = [None] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(end - 1, -1, -1):
                piece = text[start:end]
                if piece in ids:
                    a = last[start]
                    good = a is None or agree((a, piece))
                    if good is None:
                        good = pair(a, piece)
                    if good:
                        weight[end], last[end] = weight[start], piece
                        break
                elif piece not in tails:
                    break
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def path(self, segment: str) -> bytes:
        """Ids, as 32-bit integers, of a stretch no piece reaches across."""
        known = self.paths.get(segment)
        if known is not None:
            return known
        parts, inside, start = [], self.inside, 0
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in inside:
                parts.append(segment[start:i])
                start = i
        if parts:
            parts.append(segment[start:])
            done = b"".join([self.path(p) for p in parts])
        elif len(segment) == 1 and segment not in self.ids:  # no piece: its bytes
            done = array("i", [self.byte_ids[b] for b in segment.encode()]).tobytes()
        else:
            # Runs of marks have equal scores; among those the place decides.
            pieces = self.merge(segment) if MARK * 2 in segment else self.shortest(segment)
            done = array("i", [self.ids[p] for p in pieces]).tobytes()
        if len(segment) <= 64:
            if len(self.paths) >= self.most_cached:
                self.paths.clear()
            self.paths[segment] = done
        return done

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in native order."""
        if not text:
            return b""
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        known, path = self.paths.get, self.path
        return b"".join([known(s) or path(s) for s in SEGMENT.findall(marked)])

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join([self.bytes_of[i] for i in ids])
        if self.model.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", errors="replace")


# No piece has a mark after another character, and a line end is no piece.
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

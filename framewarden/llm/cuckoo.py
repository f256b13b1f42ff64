"""A cuckoo filter: short fingerprints of 64-bit keys in buckets of four, each in one of two buckets."""

from __future__ import annotations

from array import array
from collections.abc import Iterable

SLOTS = 4
#: A key that still has no place after so many moves goes to the stash.
MOST_MOVES = 200
_ONES = (1 << 64) - 1


def scrambled(x: int) -> int:
    """A bijective scramble of a 64-bit number."""
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _ONES
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & _ONES
    return x ^ (x >> 33)


def buckets_for(keys: int) -> int:
    """A power of two of buckets that ``keys`` fill by nine tenths at most."""
    return 1 << max(1, -(-keys * 10 // (9 * SLOTS)) - 1).bit_length()


class CuckooFilter:
    """Keys may be added, looked up and, if they were added, taken out again.

    A look-up never misses a key that is in; it also says yes to some that are
    not.  A key without a place goes to the stash, which marks the filter as
    overflowed: it is to be built anew, larger, from the keys themselves, since
    fingerprints alone do not tell the bucket in a larger table.
    """

    def __init__(self, buckets: int, bits: int = 16, slots: bytes | None = None, stash: Iterable[int] = ()):
        self.buckets, self.bits = buckets, bits
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))
        self.stash = list(stash)  # keys in full

    @property
    def overflowed(self) -> bool:
        return bool(self.stash)

    def _places(self, key: int) -> tuple[int, int, int]:
        h = scrambled(key)
        mark = (h >> 48) % ((1 << self.bits) - 1) + 1  # 0 is an empty slot
        first = h & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (scrambled(mark) & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.slots[at]:
                self.slots[at] = mark
                return True
        return False

    def __contains__(self, key: int) -> bool:
        mark, first, second = self._places(key)
        slots = self.slots
        return mark in slots[SLOTS * first : SLOTS * first + SLOTS] or mark in slots[SLOTS * second : SLOTS * second + SLOTS] or key in self.stash

    def add(self, key: int) -> None:
        mark, first, second = self._places(key)
        if self.stash or not (self._put(first, mark) or self._put(second, mark) or self._moved(mark, second)):
            self.stash.append(key)

    def _moved(self, mark: int, bucket: int) -> bool:
        """Makes room by moving others to their second bucket; undone if no room is found."""
        trail, turn = [], mark
        for _ in range(MOST_MOVES):
            turn = scrambled(turn + bucket)
            at = SLOTS * bucket + turn % SLOTS
            trail.append((at, self.slots[at]))
            self.slots[at], mark = mark, self.slots[at]
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        for at, old in reversed(trail):
            self.slots[at] = old
        return False

    def remove(self, key: int) -> None:
        """Takes out a key that was added."""
        if key in self.stash:
            self.stash.remove(key)
            return
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return
        raise KeyError(key)


def built(keys: list[int], bits: int = 16, buckets: int = 0) -> CuckooFilter:
    """A filter of distinct ``keys`` with at least so many buckets, doubled until all have a place."""
    buckets = max(buckets, buckets_for(len(keys)))
    while True:
        out = CuckooFilter(buckets, bits)
        for key in keys:
            out.add(key)
        if not out.overflowed:
            return out
        buckets *= 2

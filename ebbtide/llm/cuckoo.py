"""A cuckoo filter over 64-bit keys whose insertions, deletions and look-ups are numpy operations on whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4  # fingerprints a bucket
KICKS = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets.  It never denies a key that is in it.

    A key inserted twice is in it twice and has to be deleted twice; delete only what was inserted.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (0.85 * SLOTS)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(np.asarray(keys))
        mark = (h & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, ((h >> np.uint64(16)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mixed(mark.astype(np.uint64) + np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Write what fits, in one pass; True where it didn't."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        nth = np.arange(len(b)) - np.searchsorted(b, b)  # of those that want the same bucket
        empty = self.table[b] == 0
        slot = np.argmax((np.cumsum(empty, axis=1) == (nth + 1)[:, None]) & empty, axis=1)
        fits = nth < empty.sum(axis=1)
        self.table[b[fits], slot[fits]] = mark[order][fits]
        left = np.zeros(len(b), bool)
        left[order[~fits]] = True
        return left

    def insert(self, keys: np.ndarray) -> None:
        mark, bucket = self._places(keys)
        rng = np.random.default_rng(1)
        left = self._put(mark, bucket)
        mark, bucket = mark[left], self._other(mark[left], bucket[left])
        for _ in range(KICKS):
            left = self._put(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return
            guests, first = np.unique(bucket, return_index=True)  # one guest a bucket goes in; the others wait
            waiting = np.ones(len(mark), bool)
            waiting[first] = False
            slot = rng.integers(0, SLOTS, len(guests))
            out = self.table[guests, slot].copy()
            self.table[guests, slot] = mark[first]
            mark, bucket = np.concatenate([out, mark[waiting]]), np.concatenate([self._other(out, guests), bucket[waiting]])
        raise OverflowError("the filter is full")

    @classmethod
    def holding(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with these keys, grown if the first size has no place for one."""
        capacity = len(keys)
        while True:
            try:
                found = cls(capacity)
                found.insert(keys)
                return found
            except OverflowError:
                capacity *= 2

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(keys)
        return (self.table[bucket] == mark[:, None]).any(axis=1) | (self.table[self._other(mark, bucket)] == mark[:, None]).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; a key that isn't in changes nothing or takes out its double."""
        mark, bucket = self._places(keys)
        while len(mark):
            other = self._other(mark, bucket)
            here = self.table[bucket] == mark[:, None]
            at = np.where(here.any(axis=1), bucket, other)
            there = self.table[at] == mark[:, None]
            held = there.any(axis=1)
            cell = at * SLOTS + np.argmax(there, axis=1)
            cells, first = np.unique(np.where(held, cell, -1 - np.arange(len(cell))), return_index=True)  # one key a cell and turn
            own = first[cells >= 0]
            self.table.reshape(-1)[cell[own]] = 0
            left = held.copy()
            left[own] = False
            mark, bucket = mark[left], bucket[left]

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        found = cls(0)
        found.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        found.buckets = len(found.table)
        return found

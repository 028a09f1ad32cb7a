"""Signature trees over token sets, and the dual traversal that links the sets of two trees.

A leaf holds a few sets, each with a bitmap of its hashed tokens; every node has the OR of the bitmaps under it, the range
of their sizes and the largest number of tokens that share a bit with another (its slack).  A set's tokens outside the
other side's bitmap are lost to the overlap, so two nodes can't hold a pair that overlaps in more than
``slack + bits in common`` tokens.  Pairs of nodes below the overlap that their smallest sizes need are pruned, as are
those whose size ranges are too far apart and those whose sets are all linked already.
"""

from __future__ import annotations

import numpy as np

WORDS = 16  # 64-bit words in a bitmap
LEAF = 16
FAN = 8
CHUNK = 50_000  # pairs looked at together


class TokenSets:
    """Sorted distinct tokens of several sets, end to end."""

    def __init__(self, parts: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.bits = np.zeros((len(parts), WORDS), np.uint64)
        row = np.repeat(np.arange(len(parts)), self.sizes)
        place = (self.flat % np.uint64(64 * WORDS)).astype(np.int64)
        np.bitwise_or.at(self.bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)

    def one(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many tokens set i shares with each of the others."""
        own, n = self.one(i), self.sizes[others]
        starts = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(self.at[others] - starts[:-1], n) + np.arange(starts[-1])
        theirs = self.flat[take]
        near = np.searchsorted(own, theirs).clip(max=len(own) - 1)
        total = np.concatenate([[0], np.cumsum(own[near] == theirs)])
        return total[starts[1:]] - total[starts[:-1]]


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap o of sets of a and b tokens with 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """Levels of nodes over sets in the order ``order``; level 0 is the leaves."""

    def __init__(self, sets: TokenSets, members: np.ndarray):
        first = np.array([sets.flat[sets.at[i]] for i in members], np.uint64)
        self.order = members[np.lexsort((first, sets.sizes[members]))]
        bits, low, high, slack = sets.bits[self.order], sets.sizes[self.order], sets.sizes[self.order], sets.slack[self.order]
        self.levels = []
        for width in self._widths(len(members)):
            cut = np.arange(0, len(bits), width)
            bits, low, high, slack = np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)
            self.levels.append((bits, low, high, slack))

    @staticmethod
    def _widths(n: int) -> list[int]:
        widths, n = [LEAF], -(-n // LEAF)
        while n > 1:
            widths.append(FAN)
            n = -(-n // FAN)
        return widths


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of node or set pairs (bits, low, high, slack)[i], [j]: which may hold a link."""
    (bits_a, low_a, high_a, slack_a), (bits_b, low_b, high_b, slack_b) = a, b
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), CHUNK):
        x, y = i[at : at + CHUNK], j[at : at + CHUNK]
        common = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1).astype(np.int64)
        bound = np.minimum(slack_a[x], slack_b[y]) + common
        sizes = (100 * high_a[x] >= percent * low_b[y]) & (100 * high_b[y] >= percent * low_a[x])
        keep[at : at + CHUNK] = sizes & (bound >= needed(low_a[x], low_b[y], percent))
    return keep


def _children(i: np.ndarray, j: np.ndarray, fan: int, n: int, m: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(fan)
    x = (i[:, None, None] * fan + step[None, :, None] + 0 * step[None, None, :]).ravel()
    y = (j[:, None, None] * fan + 0 * step[None, :, None] + step[None, None, :]).ravel()
    good = (x < n) & (y < m) & ((x <= y) if same else True)
    return x[good], y[good]


def candidate_pairs(sets: TokenSets, a: Tree, b: Tree, percent: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that the traversal of two trees (or of one with itself) can't prune.

    ``group``: pairs of one group need no look, as they are linked already.
    """
    same = a is b
    depth = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        own, other = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if level < depth - 1:
            n, m = (len(x[0]) for x in (own, other))
            if level < len(a.levels) - 1 and level < len(b.levels) - 1:
                i, j = _children(i, j, FAN, n, m, same)
            elif level < len(a.levels) - 1:
                i, j = (np.repeat(i, FAN) * FAN + np.tile(np.arange(FAN), len(i))), np.repeat(j, FAN)
                i, j = i[i < n], j[i < n]
            elif level < len(b.levels) - 1:
                i, j = np.repeat(i, FAN), (np.repeat(j, FAN) * FAN + np.tile(np.arange(FAN), len(j)))
                i, j = i[j < m], j[j < m]
        keep = _possible(own, other, i, j, percent)
        i, j = i[keep], j[keep]
    leaves = [(s.bits[t.order], s.sizes[t.order], s.sizes[t.order], s.slack[t.order]) for s, t in ((sets, a), (sets, b))]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(i), 2_000):
        x, y = _children(i[at : at + 2_000], j[at : at + 2_000], LEAF, len(a.order), len(b.order), same)
        if same:
            x, y = x[x < y], y[x < y]
        if group is not None:
            differ = group[a.order[x]] != group[b.order[y]]
            x, y = x[differ], y[differ]
        keep = _possible(*leaves, x, y, percent)
        found.append((a.order[x[keep]], b.order[y[keep]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def link(sets: TokenSets, pairs: tuple[np.ndarray, np.ndarray], labels: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], int]:
    """Join, in ``labels``, the groups of the pairs that reach ``percent``; pairs of one group aren't looked at.

    Returns the links that joined groups, and how many pairs were compared token by token.
    """
    i, j = pairs
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else np.zeros(1, int)
    links, compared = [], 0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        x, others = int(i[lo]), j[lo:hi]
        others = others[labels[others] != labels[x]]
        if not len(others):
            continue
        shared = sets.overlaps(x, others)
        compared += len(others)
        close = others[100 * shared >= percent * (sets.sizes[x] + sets.sizes[others] - shared)]
        for y in close.tolist():
            if labels[y] != labels[x]:
                links.append((x, y))
                labels[labels == labels[y]] = labels[x]
    return links, compared

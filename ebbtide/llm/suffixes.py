"""Suffix arrays by two-stage sorting, on whole numpy arrays.

A suffix that is smaller than its successor is sorted directly; the others are induced: scanned in ascending order, each
suffix puts the one that starts a byte earlier at the next free place of its first byte's bucket.  Order is by the first
``depth`` bytes at least, which is all that common prefixes up to ``depth`` need.
"""

from __future__ import annotations

import numpy as np

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def eights(text: np.ndarray, pad: int) -> np.ndarray:
    """At each place of the text its next 8 bytes as a big-endian number; zeros follow the text, ``pad`` places of them."""
    n = len(text) + pad
    padded = np.zeros(n + 16, np.uint8)
    padded[: len(text)] = text
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        part = padded[k : k + 8 * ((n + 15 - k) // 8)].view(">u8")
        out[k::8] = part[: len(out[k::8])] if len(part) >= len(out[k::8]) else np.append(part, np.zeros(len(out[k::8]) - len(part), np.uint64))
    return out[:n]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later; the last suffix never is."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    differ = text[1:] != text[:-1]
    change = np.flatnonzero(differ)  # the last place of each run of one byte
    rises = text[change] < text[change + 1]
    run = np.zeros(n, np.int64)
    np.cumsum(differ, out=run[1:])
    return np.append(rises, False)[run]


def sort_directly(places: np.ndarray, x8: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the bytes that follow them, up to ``depth`` bytes.

    Sorted by 8 bytes at a time; suffixes that tie skip what all of their group have in common, by hashes of 8, 16, ...
    bytes, so equal ones cost a few looks whatever the depth.
    """
    steps = max(int(np.ceil(np.log2(max(depth, 8) / 8))), 0)
    hashes = [stir(x8 * _C1)]
    for k in range(steps):
        h, w = hashes[-1], 8 << k
        later = np.concatenate([h[w:], np.zeros(min(w, len(h)), np.uint64)])[: len(h)]
        hashes.append(stir(h * _C1 + later * _C2))
    out = places[np.argsort(x8[places], kind="stable")]
    group = np.concatenate([[0], np.cumsum(x8[out[1:]] != x8[out[:-1]])]) if len(out) else np.zeros(0, np.int64)
    at = np.arange(len(out))  # where the tied ones stand in out
    deep = np.full(len(out), 8, np.int64)
    while len(at):
        start = np.ones(len(at), bool)
        start[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(at)))
        tied = np.repeat((size > 1) & (deep[first] < depth), size)
        if not tied.any():
            break
        at, group, deep = at[tied], group[tied], deep[tied]
        start = np.ones(len(at), bool)
        start[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(at)))
        here, number = out[at], np.repeat(np.arange(len(first)), size)
        own = deep[first]
        for k in range(steps, -1, -1):
            h = hashes[k]
            place = np.minimum(here + own[number], len(h) - 1)
            same = np.logical_and.reduceat(h[place] == h[place[first]][number], first)
            own = np.where(same & (own < depth), own + (8 << k), own)
        deep = own[number]
        key = x8[np.minimum(here + deep, len(x8) - 1)]
        order = np.lexsort((key, number))
        out[at] = here[order]
        key, deep = key[order], deep[order] + 8
        new = np.ones(len(at), bool)
        new[1:] = (number[1:] != number[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
    return out


def with_inducers(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The wanted places and all that they are induced from: those that follow, up to the first one sorted directly."""
    n = len(wanted)
    place = np.arange(n)
    stop = np.minimum.accumulate(np.where(small, place, n - 1)[::-1])[::-1]  # the first small one from here on, else the last place
    last = np.maximum.accumulate(np.where(wanted, stop, -1))
    return place <= last


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All places of the text (bytes), in the order of their suffixes up to ``depth`` bytes at least.

    Given ``wanted`` (true or false for each place), those places only, so others cost nothing but what induces these.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    x8 = eights(text, 8)
    small = smaller_than_next(text)
    needed = np.ones(n, bool) if wanted is None else with_inducers(wanted, small)
    induced = needed & ~small
    direct = sort_directly(np.flatnonzero(needed & small), x8, depth)
    edge = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        buckets[text[n - 1]].append(np.array([n - 1]))

    def induce(found: np.ndarray, own: int) -> np.ndarray:
        """Put what starts a byte earlier in its bucket; returns those of the bucket ``own`` itself."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.diff(first)) + 1
        mine = np.zeros(0, np.int64)
        for part in np.split(before, cut) if len(before) else ():
            c = int(text[part[0]])
            if c == own:
                mine = part
            else:
                buckets[c].append(part)
        return mine

    out = []
    for c in range(256):
        queue = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64)
        while len(queue):
            out.append(queue)
            queue = induce(queue, c)
        own = direct[edge[c] : edge[c + 1]]
        if len(own):
            out.append(own)
            induce(own, -1)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(order: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix in ``order`` shares with the one before it, up to ``depth``; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    x8 = eights(text, depth + 8)
    a, b, left = order[1:], order[:-1], np.arange(1, len(order))
    for d in range(0, depth, 8):
        x = x8[a + d] ^ x8[b + d]
        differ = x != 0
        if differ.any():
            lead = np.zeros(int(differ.sum()), np.int64)
            y = x[differ]
            for k in range(7, 0, -1):
                lead += (y >> np.uint64(8 * k)) == 0
            lcp[left[differ]] = np.minimum(d + lead, depth)
            a, b, left = a[~differ], b[~differ], left[~differ]
    lcp[left] = depth
    return np.minimum(lcp, np.minimum(len(text) - order, np.append(len(text), len(text) - order[:-1])))


def alike(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Which places of ``order`` hold a suffix that shares ``length`` bytes (8 at least) with the one before; all are that long."""
    x8 = eights(text, 8)
    left = np.arange(1, len(order))
    for d in (length - 8, *range(0, length - 8, 8)):  # most that differ at all do so in the last bytes
        left = left[x8[order[left] + d] == x8[order[left - 1] + d]]
    return left

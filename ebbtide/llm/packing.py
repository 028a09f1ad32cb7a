"""Best-fit packing of token sequences, planned on the histogram of lengths.

Lengths are at most the capacity, so the histogram has at most that many bins, whatever the corpus.  All patterns of one to
three lengths that fill a sequence, wholly or but for a few tokens, are fitted to it by non-negative least squares.  The fit is
repeated on those patterns that the one before uses most for each longest length, so that few of them share the counts and
rounding down loses little; what is left is packed by best fit, longest first, a whole run of equal sequences at a time.
The plan is a list of intervals: of the pieces of one length, those numbered from ``lo`` to ``hi`` start at ``offset`` in the
sequences from ``first`` on.  Each piece finds its interval by its number among the pieces of its length, which is a
cell's offset plus a rank inside that cell, so that no task gathers a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, positions, salts_for, saved
from .tokens import encoder

CAPACITY = 4096
END = 1
SLACKS = (1 << 30, 512)  # a pattern wastes at most the capacity divided by this: nothing, or a few tokens
FITS = ((40, 12), (80, 3), (200, 3))  # steps of a fit, and the patterns of each longest length that go on to the next
SHARES = (1.0, 0.5)  # of the fitted counts, tried in this order


def cut_pieces(capacity: int, path: str | None, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text) + END.to_bytes(4, "little")
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for name, x in (("doc_id", doc), ("piece", piece), ("start", at // 4), ("length", len(own) // 4), ("ids_crc32", zlib.crc32(own))):
                            rows[name].append(x)
                        if with_ids:
                            rows["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in types.items()], list(types))

    return run


def patterns(lengths: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """All rows of one to three bins (-1: none), longest first, that end with the longest that fits and waste ``slack`` at most."""
    below = np.searchsorted(lengths, np.arange(capacity + 1), side="right") - 1  # the longest bin that isn't longer, -1 if none
    single = np.flatnonzero(capacity - lengths <= slack)
    found = [np.stack([single, np.full(len(single), -1), np.full(len(single), -1)], axis=1)]
    for a in range(len(lengths)):
        b = np.arange(min(a, below[capacity - lengths[a]]) + 1)
        rest = capacity - lengths[a] - lengths[b]
        c = np.minimum(below[rest], b)
        good = rest - np.where(c >= 0, lengths[c], 0) <= slack
        if good.any():
            found.append(np.stack([np.full(good.sum(), a), b[good], c[good]], axis=1))
    return np.concatenate(found).astype(np.int32)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
    """x >= 0 that brings the patterns' use of each bin near ``target``, by accelerated projected gradients."""
    n = len(target) + 1
    bins = [np.where(own >= 0, own, len(target)).astype(np.int32) for own in columns.T]  # the last bin stands for none
    goal = np.append(target.astype(float), 0.0)
    degree = sum(np.bincount(own, minlength=n) for own in bins).astype(float)
    degree[-1] = 0
    step = 1.0 / np.maximum(sum(degree[own] for own in bins), 1.0)  # a diagonal that majorises A'A
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(steps):
        off = sum(np.bincount(own, y, n) for own in bins) - goal
        off[-1] = 0
        new = np.maximum(y - step * sum(off[own] for own in bins), 0.0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = np.maximum(new + (was - 1) / t * (new - x), 0.0)
        x = new
    return x


def fitted(columns: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few of the patterns, and how often each is to be used."""
    times = np.zeros(0)
    for steps, keep in FITS:
        times = nonnegative_least_squares(columns, target, steps)
        order = np.lexsort((-times, columns[:, 0]))
        first = columns[order, 0]
        strong = np.arange(len(order)) - np.searchsorted(first, first) < keep
        best = np.sort(order[strong & (times[order] > 0)])
        columns, times = columns[best], times[best]
    return columns, times


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, lo, hi, first sequence, offset) that place every piece, and the number of sequences.

    Patterns that use up the very lengths that would fill gaps can cost more than they save, so plans with whole and with
    half the fitted counts, of patterns that waste nothing or little, are tried, and the one of fewest sequences stands; one
    that wastes less than a sequence stands at once.
    """
    wanted = {k: int(n) for k, n in histogram.items() if n > 0}
    if any(not 1 <= k <= capacity for k in wanted):
        raise ValueError("a length is outside 1..capacity")
    if not wanted:
        return [], 0
    lengths = np.array(sorted(wanted))
    least = -(-sum(k * n for k, n in wanted.items()) // capacity)
    best = None
    for slack in SLACKS:
        columns, times = fitted(patterns(lengths, capacity, capacity // slack), np.array([wanted[k] for k in lengths]))
        for share in SHARES:
            found = _planned(wanted, capacity, lengths, columns, times * share)
            if best is None or found[1] < best[1]:
                best = found
            if best[1] == least:
                return best
    return best


def _planned(wanted: dict[int, int], capacity: int, lengths: np.ndarray, columns: np.ndarray, times: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The patterns as often as ``times`` says, rounded down, then the rest by best fit."""
    left = dict(wanted)
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, first, offset))
        used[length] += n
        left[length] -= n

    for i in np.argsort(-times, kind="stable"):
        if times[i] < 1:
            break
        parts = [int(lengths[b]) for b in columns[i] if b >= 0]
        n = min(int(times[i]), *(left[k] // parts.count(k) for k in parts))
        if n > 0:
            offset = 0
            for k in parts:
                place(k, n, sequences, offset)
                offset += k
            sequences += n
    rooms: list[int] = []  # what is free in open sequences, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by that: (first sequence, how many)

    def opened(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not runs[room]:
                bisect.insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left[length])
                opened(capacity, sequences, left[length] // each)
                sequences += left[length] // each
                continue
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                rooms.pop(at)
            take = min(n, left[length])
            place(length, take, first, capacity - room)
            opened(room, first + take, n - take)
            opened(room - length, first, take)
    return out, sequences


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of all documents, each with its place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A null text is an empty one, whose only id is the end.  Only documents of more than ``capacity`` ids are cut.  Rows
    that repeat a document are packed once each.  No rows give no rows.
    """
    spark = docs.sparkSession
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    slim = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    pieces = saved(slim.mapInArrow(cut_pieces(capacity, tokenizer, with_ids), kinds))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    intervals, _ = plan(histogram, capacity)
    table = spark.createDataFrame(intervals, "_length long, _lo long, _hi long, _first long, _offset long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts_for(sum(histogram.values())))))
    ranked = positions(salted, ["length"], ["_salt"], ["doc_id", "piece"], "_at")
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return found.select(*pieces.columns, (F.col("_first") + F.col("_at") - F.col("_lo")).alias("sequence_id"), F.col("_offset").alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(documents(spark, sf_dir), with_ids=False)

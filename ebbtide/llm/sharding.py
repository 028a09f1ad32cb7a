"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A row's place on the ring is the hash of its text, so equal texts start at one place.  The ring has ``2**ring_bits``
slots and every shard has ``vnodes`` virtual nodes on it.  A row goes to the next virtual node clockwise; rows that a
full shard cannot take continue clockwise to the next shard with room.

Rows of one slot are interchangeable for the loads, so the overflow is settled on the slots' counts (``2**ring_bits``
numbers, whatever the input) and each row finds its shard by its position in its slot.  Positions go by the hash of the
text, so equal texts are side by side and only one that the end of a shard falls into is parted.  No task gathers a slot: a
position is a cell's offset plus a rank inside that cell, and a hot text has cells of its own.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, positions, saved

RING_BITS = 12
VNODES = 64
CELL = 250_000  # rows of a cell, on average at most


def _mix(x: int) -> int:
    """A 64-bit finalizer, for places of virtual nodes that are the same on every driver."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> list[tuple[int, int]]:
    """The virtual nodes as (place, shard) in clockwise order.  A shard's places don't depend on the other shards."""
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be at least 1")
    return sorted((_mix(s * 1_000_003 + v) >> (64 - ring_bits), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, load: float) -> list[int]:
    """Room of each shard.  ``load`` 1 gives counts at most one apart; above 1, ceil(load * mean)."""
    if load < 1:
        raise ValueError("load must be at least 1")
    if load == 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-load * total // shards)] * shards


def allocate(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (slot, from, to, shard, first place in the shard) that hold each slot's rows.

    First every slot goes whole to its own shard, in clockwise order, if there is room; then those that are over go whole to
    the next shard clockwise that has room for them; what fits nowhere whole is parted, clockwise again.
    """
    places, room, taken = [p for p, _ in nodes], list(room), [0] * len(room)
    segments, over = [], []

    def put(slot: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, room[shard])
        if n > 0:
            segments.append((slot, start, start + n, shard, taken[shard]))
            taken[shard] += n
            room[shard] -= n
        return start + max(n, 0)

    for slot in sorted(counts):
        at = bisect.bisect_left(places, slot) % len(nodes)
        if counts[slot] <= room[nodes[at][1]]:
            put(slot, 0, counts[slot], nodes[at][1])
        else:
            over.append((slot, at))
    parted = []
    for slot, at in over:
        step = next((s for s in range(1, len(nodes)) if counts[slot] <= room[nodes[(at + s) % len(nodes)][1]]), None)
        if step is None:
            parted.append((slot, at))
        else:
            put(slot, 0, counts[slot], nodes[(at + step) % len(nodes)][1])
    for slot, at in parted:
        start = 0
        for step in range(len(nodes)):
            start = put(slot, start, counts[slot], nodes[(at + step) % len(nodes)][1])
            if start == counts[slot]:
                break
        else:
            raise ValueError("the shards have less room than there are rows")
    return segments


def shard_rows(df: DataFrame, shards: int = 16, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), load: float = 1.0, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> DataFrame:
    """Give each row its ``shard`` and its ``slot`` there (gapless from 0).

    Returns ``keep`` and ``size`` (bytes of the text + 1), ``text_crc32``, ``shard``, ``slot``.  A null text counts as
    no bytes.  Rows that are repeated each get a slot of their own.  No rows give no rows.
    """
    spark = df.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.xxhash64(value)
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    slim = saved(df.select(*kept, (F.octet_length(value) + 1).cast("long").alias("_size"), F.crc32(value).alias("_crc"), place.alias("_hash"), F.shiftrightunsigned(place, 64 - ring_bits).alias("_slot")))
    ids = [f"_k{i}" for i in range(len(keep))]
    counts = {r[0]: r[1] for r in slim.groupBy("_slot").count().collect()}  # 2**ring_bits rows at most
    total = sum(counts.values())
    segments = allocate(counts, ring(shards, vnodes, ring_bits), capacities(total, shards, load))
    table = spark.createDataFrame(segments, "_slot long, _from long, _to long, _shard int, _first long")
    part_bits = max(4, (total // (CELL << ring_bits)).bit_length())
    hot = slim.groupBy(F.col("_hash").alias("_hot")).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_cells")).filter("_cells > 1")  # a row for each CELL rows at most
    hot = F.broadcast(hot) if total // CELL <= 1_000_000 else hot
    cells = slim.join(hot, F.col("_hash") == F.col("_hot"), "left").withColumns({"_part": F.shiftrightunsigned(F.shiftleft(F.col("_hash"), ring_bits), 64 - part_bits), "_hot": F.coalesce("_hot", F.lit(0)), "_salt": F.pmod(F.xxhash64(*ids), F.coalesce("_cells", F.lit(1)))}).drop("_cells")
    ranked = positions(cells, ["_slot"], ["_part", "_hot", "_salt"], ["_hash", *ids], "_at")
    found = ranked.join(F.broadcast(table), (ranked["_slot"] == table["_slot"]) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_first") + F.col("_at") - F.col("_from")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts are at most one apart."""
    found = shard_rows(documents(spark, sf_dir), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""What the searches over vectors share: valid vectors, each once, in blocks that meet the queries block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, saved
from .words import rows

BLOCK = 4_096  # vectors of a block
QUERIES = 2_048  # queries of a block
SAMPLE = 2_048  # vectors whose scores give each query a first bound


def as_rows(blobs: list[bytes], dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def vectors(df: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None, *, nonzero: bool, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, blob): the vectors as doubles, after ``change``, without those that take no part.

    Null ids or vectors, empty vectors and those with null or non-finite components take no part; with ``nonzero`` nor do
    zero vectors; nor do those whose length isn't the commonest one (of several, the largest).
    """

    def run(batches):
        for batch in batches:
            ids, blobs = [], []
            for own, x in rows(batch):
                if own is None or not x or None in x:
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all() and (x.any() or not nonzero):
                    ids.append(own)
                    blobs.append((change(x) if change else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["id", "blob"])

    slim = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    found = saved(slim.mapInArrow(run, "id long, blob binary"))
    lengths = found.groupBy(F.octet_length("blob").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return found.filter(F.octet_length("blob") == (lengths["w"] if lengths else 0))


def distinct(found: DataFrame, ids: int) -> DataFrame:
    """(blob, ids): each vector once with its ``ids`` smallest ids, ascending.

    More ids of one vector than the results ask for, and one for the query itself, can't be in any result.
    """
    order = F.dense_rank().over(Window.partitionBy("blob").orderBy("id"))
    return found.withColumn("r", order).filter(F.col("r") <= ids).groupBy("blob").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def sampled(points: DataFrame, bound: int) -> tuple[np.ndarray, list[list[int]]]:
    """About ``bound`` of the distinct vectors, by a hash, with their ids; at most 1.3 times as many."""
    got = bounded_sample(points, F.col("blob"), bound).limit(bound * 13 // 10).orderBy("blob").collect()
    return as_rows([bytes(r["blob"]) for r in got]), [r["ids"] for r in got]


def parts(counts: dict[int, int], size: int) -> tuple[list[int], list[int], int]:
    """For cells 0, 1, ...: their first block, how many blocks they have, and how many there are in all."""
    n = max(counts, default=-1) + 1
    each = [max(1, -(-counts.get(c, 0) // size)) for c in range(n)]
    first = [sum(each[:c]) for c in range(n)] if n < 2 else np.concatenate([[0], np.cumsum(each[:-1])]).tolist()
    return [int(x) for x in first], each, sum(each)


def runs(counts: dict[int, int], size: int) -> tuple[list[int], list[int], int]:
    """Like ``parts``, but small cells that follow each other share a part of about ``size``."""
    n = max(counts, default=-1) + 1
    first, each, at, held = [], [], 0, 0
    for c in range(n):
        own = counts.get(c, 0)
        if held and held + own > size:
            at, held = at + 1, 0
        first.append(at)
        each.append(max(1, -(-own // size)))
        at, held = (at + each[-1], 0) if own > size else (at, held + own)
    return first, each, at + 1


def placed_in(first: list[int], each: list[int]) -> Column:
    """The part of a row with columns cell and blob, by ``parts`` or ``runs``."""
    at = lambda x: F.element_at(F.array(*[F.lit(i) for i in x or [0]]), F.col("cell") + 1)
    return (at(first) + F.pmod(F.xxhash64("blob"), at([*each] or [1]))).cast("int")


def in_cells(df: DataFrame, middle: np.ndarray) -> DataFrame:
    """``df`` with the nearest row of ``middle`` to its blob as cell, and how far that is."""
    half, names = (middle**2).sum(axis=1) / 2, df.columns

    def run(batches):
        for batch in batches:
            own = as_rows([b for (b,) in rows(batch.select(["blob"]))])
            cell = np.argmax(own @ middle.T - half, axis=1) if len(own) else np.zeros(0, int)
            far = np.sqrt(((own - middle[cell]) ** 2).sum(axis=1)) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*names, "cell", "far"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, far double")


def cells_of(celled: DataFrame, n: int) -> tuple[dict[int, int], np.ndarray]:
    """How many rows each of ``n`` cells has, and the radius that covers them (-1 if there are none)."""
    counts, radius = {}, np.full(n, -1.0)
    for cell, own, far in celled.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect():  # a row a cell
        counts[cell], radius[cell] = own, far * (1 + 1e-9) + 1e-9
    return counts, radius


def meet(queries: DataFrame, points: DataFrame, search: Callable, k: int, order: list, kind: str = "double") -> DataFrame:
    """Search every block of points for the queries that are to meet it, and keep each query's best k.

    ``queries``: id, blob, bound, blocks (array of the blocks to meet), part; ``points``: blob, ids, block.  A block goes to the
    parts of which a query asks for it.  ``search`` gets two tables and returns query_id, vec_id, score.
    """
    q = saved(queries).select("id", "blob", "bound", "part", F.explode("blocks").alias("block"))
    wanted = q.select(F.col("block").alias("to"), F.col("part").alias("seat")).distinct()
    p = points.join(wanted, F.col("block") == F.col("to")).select("blob", "ids", "block", F.col("seat").alias("part"))
    found = q.groupBy("block", "part").cogroup(p.groupBy("block", "part")).applyInArrow(search, f"query_id long, vec_id long, score {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hits(query: list[int], vec: list[int], score: list, kind: pa.DataType = pa.float64()) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, kind)})

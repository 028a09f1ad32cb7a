"""Approximate nearest neighbours by an adaptive dimension scan inside inverted lists.

Vectors are turned by a random rotation, which spreads a distance evenly over the dimensions, and stored in column blocks.
A query scans the candidates of a probed list block by block; after each block the partial distances are scaled up and a
hypothesis test gives up those that would, but for a small chance, end beyond the query's kth distance.  What survives
all blocks is measured on the original vectors in double precision.

Those of a bounded sample that are in a query's probed lists give it its first kth distance, which every run of candidates
that it scans may lower.  A probed list whose radius keeps all of it beyond that distance is left out before anything is
shipped to it.  Results come from the lists only; a query that finds fewer than k there scans all lists, without a test.

Lists have centroids from k-means on a bounded sample; every vector is indexed.  Large lists are cut into blocks, equal
vectors are one point with its smallest ids, and queries are dealt to parts by their nearest list, so no task grows with a
list or a copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .vectors import BLOCK, QUERIES, SAMPLE, as_rows, cells_of, distinct, hits, in_cells, meet, parts, placed_in, runs, sampled, vectors
from .words import rows

TRAIN = 12_000  # vectors that the centroids are fitted on
LISTS = 1_024  # most lists
COLUMNS = 16  # dimensions of a column block
TEST = 2.1  # standard errors at which the test gives a candidate up
PROBE = 0.55  # share of the lists that a query probes, when they are many
SCAN = 1_024  # candidates that are scanned before the kth distance is taken anew
FEW = 0.75  # that more of the square root of the number of lists: few lists part neighbours more often


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        of = np.argmax(sample @ found.T - (found**2).sum(axis=1) / 2, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, of, sample)
        count = np.bincount(of, minlength=len(found))
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


def scan(query: np.ndarray, columns: list[np.ndarray], limit: float, test: float = TEST) -> np.ndarray:
    """The candidates that no test gives up, for a squared distance ``limit`` to beat or to tie with."""
    d = len(query)
    alive = np.arange(columns[0].shape[1])
    partial = np.zeros(len(alive))
    at = 0
    for block in columns:
        own = block if len(alive) == block.shape[1] else block[:, alive]
        partial = partial + ((own - query[at : at + len(block), None]) ** 2).sum(axis=0)
        at += len(block)
        slack = 1e-9 if at == d else test / np.sqrt(at)
        keep = partial * (d / at) <= limit * (1 + slack) ** 2
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive


def within_reach(queries: np.ndarray, limit: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query the lists that may hold a vector within its squared distance ``limit``."""
    apart = (queries**2).sum(axis=1)[:, None] + (middle**2).sum(axis=1) - 2 * queries @ middle.T
    least = np.sqrt(np.maximum(apart, 0)) * (1 - 1e-9) - 1e-6 - radius
    return (least <= np.sqrt(limit)[:, None]) & (radius >= 0)


def nearest_found(df: DataFrame, is_query, k: int, *, probe: float = PROBE, test: float = TEST, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows, by Euclidean distance.

    ``probe`` is the share of lists probed, to which ``FEW`` adds for few lists: the vectors here have no clusters, so recall 0.9 takes half of them; clustered
    vectors need far less.  Which vectors take part: see ``vectors``; zero vectors don't.  Fewer than k others found
    give them all; ties go to the smaller id; a row that is repeated counts once.
    """
    found = vectors(df, None, nonzero=True, vec_id=vec_id, embedding=embedding)
    points = saved(distinct(found, k + 1))
    asked = saved(found.filter(is_query(F.col("id"))).distinct())
    n = points.count()
    sample, _ = sampled(points, TRAIN)
    lists = max(1, min(LISTS, int(np.sqrt(n)), len(sample)))
    probes = min(lists, max(1, int(np.ceil(probe * lists + FEW * np.sqrt(lists)))))
    turn = rotation(sample.shape[1]) if len(sample) else np.zeros((0, 0))
    middle = centroids(sample, lists) if len(sample) else sample
    half = (middle**2).sum(axis=1) / 2

    celled = saved(in_cells(points, middle))
    counts, radius = cells_of(celled, len(middle))
    first, each, _ = parts(counts, BLOCK)
    placed = celled.select("blob", "ids", placed_in(first, each).alias("block"))
    seated = saved(in_cells(asked, middle))
    q_first, q_each, _ = runs(cells_of(seated, len(middle))[0], max(1, QUERIES * lists // probes))
    seeds = sample[:SAMPLE]
    seed_list = np.argmax(seeds @ middle.T - half, axis=1) if len(seeds) else np.zeros(0, int)

    def limits(queries: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The squared distance of each query's kth other seed in its probed lists; infinite when they hold fewer."""
        if len(seeds) <= k:
            return np.full(len(queries), np.inf)
        probed = np.zeros((len(queries), lists), bool)
        np.put_along_axis(probed, near, True, axis=1)
        apart = (queries**2).sum(axis=1)[:, None] + (seeds**2).sum(axis=1) - 2 * queries @ seeds.T
        apart[~probed[:, seed_list]] = np.inf
        return np.maximum(np.partition(apart, k, axis=1)[:, k], 0) * (1 + 1e-9) + 1e-12

    def dealt(queries: DataFrame, n_lists: int, bounded: bool) -> DataFrame:
        def to_blocks(batches):
            for batch in batches:
                own = as_rows([b for (b,) in rows(batch.select(["blob"]))])
                bound, blocks = np.zeros(0), []
                if len(own):
                    near = np.argsort(half - own @ middle.T, axis=1, kind="stable")[:, :n_lists]
                    bound = limits(own, near) if bounded else np.full(len(own), np.inf)
                    reach = within_reach(own, bound, middle, radius)
                    blocks = [[b for c in lists_of if row[c] for b in range(first[c], first[c] + each[c])] for lists_of, row in zip(near.tolist(), reach, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("blob"), pa.array(bound, pa.float64()), pa.array(blocks, pa.list_(pa.int32())), batch.column("part")], ["id", "blob", "bound", "blocks", "part"])

        return queries.select("id", "blob", placed_in(q_first, q_each).alias("part")).mapInArrow(to_blocks, "id long, blob binary, bound double, blocks array<int>, part int")

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        queries, own, bound = as_rows(q.column("blob").to_pylist()), q.column("id").to_pylist(), q.column("bound").to_pylist()
        x, ids = as_rows(p.column("blob").to_pylist()), p.column("ids").to_pylist()
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(x):
            turned, dims = queries @ turn, (x @ turn).T
            pieces = [(at, [np.ascontiguousarray(dims[i : i + COLUMNS, at : at + SCAN]) for i in range(0, len(dims), COLUMNS)]) for at in range(0, len(x), SCAN)]
            for i, name in enumerate(own):
                limit, best = bound[i], []
                for at, columns in pieces:
                    alive = at + scan(turned[i], columns, limit, test)
                    apart = np.sqrt(((x[alive] - queries[i]) ** 2).sum(axis=1))
                    best = sorted([*best, *((s, v) for s, j in zip(apart.tolist(), alive.tolist(), strict=True) for v in ids[j] if v != name)])[:k]
                    if len(best) == k:
                        limit = min(limit, best[-1][0] ** 2 * (1 + 1e-9) + 1e-12)
                out += [(name, v, s) for s, v in best]
        return hits([x[0] for x in out], [x[1] for x in out], [x[2] for x in out])

    near = saved(meet(dealt(seated, probes, True), placed, run, k, [F.asc("score")]))
    done = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = saved(seated.join(done, "id", "left_anti"))
    if short.isEmpty():
        return near
    again = meet(dealt(short, lists, False), placed, run, k, [F.asc("score")])
    return near.join(done.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(again.columns).unionByName(again)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return nearest_found(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0, 10)

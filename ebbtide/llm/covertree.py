"""Exact top-k inner products by a dual traversal of cover trees.

Queries and data are indexed alike: a node's centre is one of its vectors, its radius covers all of them, and its children
have centres that a farthest-first traversal keeps apart.  For a query node (centre c, radius r) and a data node (d, s) no
pair scores more than ``c.d + r|d| + s|c| + rs``; the pair of nodes is left when that is below the worst kth score of
the query node's group.  Data nodes are taken best bound first.  Ties count by the smaller id, so only smaller scores are
pruned.

Vectors that are equal are one point with its smallest ids.  Points and queries are dealt to blocks by their nearest pivot (a
bounded sample), and each pair of blocks is one task: no task or driver holds more than two blocks.  A bounded sample of
points gives each query a first bound, which all its tasks share.  The pivots are the top of the data tree: with their
covering radii, a query leaves out the blocks that can't reach its bound before anything is shipped to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .vectors import BLOCK, QUERIES, SAMPLE, as_rows, cells_of, distinct, hits, in_cells, meet, parts, placed_in, runs, sampled, vectors
from .words import rows

LEAF = 64
FAN = 8
PIVOTS = 512
LARGEST = 2**63 - 1


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact at any size: in double precision where that is exact, else in Python integers."""
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top * top * max(a.shape[1], 1) < 2**53:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def at_most(x) -> float:
    """A double that isn't above the number."""
    return float(x) if abs(x) < 2**53 else float(np.nextafter(float(x), -np.inf))


class Node:
    __slots__ = ("children", "far", "members", "norm", "parent", "worst", "x")

    def __init__(self, x: np.ndarray, far: float, members: np.ndarray, parent: Node | None):
        self.x, self.far, self.members, self.parent = x, far, members, parent
        self.norm = float(np.sqrt(x @ x))
        self.children: list[Node] = []
        self.worst = -np.inf


def cover_tree(points: np.ndarray) -> Node:
    """Top down; a node of LEAF points at most, or of equal points, is a leaf."""

    def grow(members: np.ndarray, parent: Node | None) -> Node:
        own = points[members]
        away = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
        node = Node(own[0], float(away.max()) * (1 + 1e-12), members, parent)
        if len(members) > LEAF and node.far > 0:
            nearest, of, n = away, np.zeros(len(members), int), 1
            while n < FAN and nearest.max() > node.far / 2:
                d = np.sqrt(((own - own[int(np.argmax(nearest))]) ** 2).sum(axis=1))
                closer = d < nearest
                of[closer], n = n, n + 1
                nearest = np.minimum(nearest, d)
            node.children = [grow(members[of == c], node) for c in range(n) if (of == c).any()]
        return node

    return grow(np.arange(len(points)), None)


class TopK:
    """The best k of each query so far; ``kth`` starts at a score that k points are known to reach."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.kth = ids, k, floor.astype(float)
        self.best: list[list[tuple]] = [[] for _ in ids]

    def offer(self, i: int, scores: list, ids: list[list[int]]) -> None:
        own, best = self.ids[i], self.best[i]
        best += [(-s, v) for s, vs in zip(scores, ids, strict=True) for v in vs if v != own]
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.kth[i] = max(self.kth[i], at_most(-best[-1][0]))


def search(queries: np.ndarray, top: TopK, points: np.ndarray, ids: list[list[int]]) -> int:
    """Fill ``top`` with the best points; returns how many pairs of nodes were scored point by point."""
    if not len(queries) or not len(points):
        return 0
    q_root, d_root = cover_tree(queries), cover_tree(points)
    done = 0

    def settle(node: Node) -> None:
        while node is not None:
            worst = min(c.worst for c in node.children) if node.children else float(top.kth[node.members].min())
            if worst == node.worst:
                return
            node.worst, node = worst, node.parent

    def start(node: Node) -> float:
        node.worst = min(map(start, node.children)) if node.children else float(top.kth[node.members].min())
        return node.worst

    def bound(q: Node, d: Node) -> float:
        return (float(q.x @ d.x) + q.far * d.norm + d.far * q.norm + q.far * d.far) * (1 + 1e-9) + 1e-6

    start(q_root)
    stack = [(bound(q_root, d_root), q_root, d_root)]
    while stack:
        most, q, d = stack.pop()
        if most < q.worst:
            continue
        if not q.children and not d.children:
            scores = inner(queries[q.members], points[d.members])
            done += 1
            reach = scores >= top.kth[q.members][:, None]
            for i in np.flatnonzero(reach.any(axis=1)).tolist():
                at = np.flatnonzero(reach[i])
                top.offer(int(q.members[i]), scores[i][at].tolist(), [ids[j] for j in d.members[at].tolist()])
            settle(q)
            continue
        split_q = q.children and (not d.children or len(q.members) >= len(d.members))
        pairs = [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]
        stack += sorted(((b, x, y) for x, y in pairs if (b := bound(x, y)) >= x.worst), key=lambda p: p[0])
    return done


def floors(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, sample_ids: list[list[int]], k: int) -> np.ndarray:
    """A score that at least k points other than the query reach; -inf if the sample is too small."""
    if not len(sample) or not len(queries):
        return np.full(len(queries), -np.inf)
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    scores = np.sort(inner(queries, sample), axis=1)
    return np.array([at_most(x) for x in scores[:, -(k + 1)]])  # one of the sample may be the query itself


def reachable(queries: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query the cells that may hold a point whose score isn't below its bound."""
    centre = queries @ pivots.T
    most = centre + np.sqrt((queries**2).sum(axis=1))[:, None] * radius
    return (most + 1e-9 * np.abs(most) + 1e-6 >= bound[:, None]) & (radius >= 0)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(64 * x)


def top_inner_products(df: DataFrame, is_query, k: int, *, change=quantised, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows.

    ``is_query`` tells queries by their id column; ``change`` maps a vector to the one that takes part, whose components
    must be integers.  Which vectors take part: see ``vectors``.  Fewer than k others give them all; ties go to the
    smaller id; a row that is repeated counts once.  A score beyond 63 bits counts as the largest there is.
    """
    found = vectors(df, change, nonzero=False, vec_id=vec_id, embedding=embedding)
    points = saved(distinct(found, k + 1))
    asked = saved(found.filter(is_query(F.col("id"))).distinct())
    n = points.count()
    sample, sample_ids = sampled(points, SAMPLE)
    pivots = sample[: max(1, min(PIVOTS, n // BLOCK))]
    celled = saved(in_cells(points, pivots))
    counts, radius = cells_of(celled, len(pivots))
    first, each, _ = parts(counts, BLOCK)
    placed = celled.select("blob", "ids", placed_in(first, each).alias("block"))
    seated = saved(in_cells(asked, pivots))
    q_first, q_each, _ = runs(cells_of(seated, len(pivots))[0], QUERIES)

    def to_blocks(batches):
        for batch in batches:
            own = as_rows([b for (b,) in rows(batch.select(["blob"]))])
            bound = floors(own, batch.column("id").to_numpy(), sample, sample_ids, k)
            reach = reachable(own, bound, pivots, radius) if len(own) else []
            blocks = [[b for c in np.flatnonzero(row).tolist() for b in range(first[c], first[c] + each[c])] for row in reach]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("blob"), pa.array(bound, pa.float64()), pa.array(blocks, pa.list_(pa.int32())), batch.column("part")], ["id", "blob", "bound", "blocks", "part"])

    dealt = seated.select("id", "blob", placed_in(q_first, q_each).alias("part")).mapInArrow(to_blocks, "id long, blob binary, bound double, blocks array<int>, part int")

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        queries, own = as_rows(q.column("blob").to_pylist()), q.column("id").to_numpy()
        top = TopK(own, k, q.column("bound").to_numpy())
        search(queries, top, as_rows(p.column("blob").to_pylist()), p.column("ids").to_pylist())
        flat = [(int(i), v, max(-LARGEST, min(LARGEST, int(-s)))) for i, best in zip(own, top.best, strict=True) for s, v in best]
        return hits([x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat], pa.int64())

    return meet(dealt, placed, run, k, [F.desc("score")], kind="long")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others, in 64ths rounded down."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(table, lambda i: i % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

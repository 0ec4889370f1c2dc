"""Approximate nearest neighbours by inner product with vantage-point trees.

Each shard gets a tree. Vectors are lifted by one component, the root of
(largest norm)^2 - |x|^2, and queries by a zero: then the Euclidean distance
falls as the inner product grows, and being a metric it allows pruning by the
triangle inequality. A node splits its points at the median distance from its
vantage point; with a query at distance d and the k-th best distance t so far,
the inner half can hold something nearer only if d - t <= median, the outer
half only if d + t >= median. ``factor`` multiplies t in both tests: factor one
is exact search, smaller ones prune more and may miss neighbours.

A whole chunk of queries goes down the tree together, each node splitting the
set of queries that still need it; a first descent to each query's own leaf
gives t a good start. Equal vectors are one point with a list of ids, so a
vector that occurs in a third of all rows costs one point a shard; of each
point the k + 1 smallest ids are looked at, more cannot be among the k best.
Scores are inner products of the original vectors in double precision, added
in component order, and ties go to the smaller id.

Defined cases: vectors null, zero, empty or with null or non-finite
components, and rows without id, take no part; a row is never a candidate of a
query with its own id; repeated rows are candidates each; fewer than k
candidates: all of them; empty table: empty result. A product beyond double
precision is infinite and ranks as that; a sum of infinities of both signs
counts as minus infinity. Queries or shards with infinite distances are
compared with every point.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.common import table
from ferry.llm.vectors import search, usable

K = 20
EVERY = 20
LEAF = 64
#: multiplies the search radius in the pruning tests; below one the search may miss
#: neighbours, and saves little on 64 dimensions (see the README)
FACTOR = 1.0
#: more points than k are kept, so that rounding in block products cannot cost a place
SPARE = 4


def build(ids: np.ndarray, v: np.ndarray) -> dict:
    """The tree over the distinct vectors of a shard; ids come sorted."""
    points, where = np.unique(v, axis=0, return_inverse=True)
    where = where.reshape(-1)
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(len(points) + 1))
    # points in the order of their smallest id: ties go to the lower index
    first = ids[order[starts[:-1]]]
    rank = np.argsort(first, kind="stable")
    lists = [ids[order[starts[p]:starts[p + 1]]] for p in rank]
    points = points[rank]
    with np.errstate(over="ignore"):
        square = (points * points).sum(1)
    huge = not np.isfinite(square.max())    # no distances: such a shard has no tree
    if huge:
        square = np.full(len(points), np.inf)
    lifted = np.concatenate([points, np.sqrt(np.maximum(square.max() - square, 0.0))[:, None]
                             if not huge else np.zeros((len(points), 1))], 1)

    perm = np.arange(len(points))
    nodes: list[tuple[int, float, int, int, int, int]] = []   # vantage, median, inner, outer, from, to
    rng = np.random.default_rng(len(points))

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, a, b))
        if b - a <= LEAF or huge:
            return at
        own = perm[a:b]
        vantage = int(own[rng.integers(len(own))])
        d = np.sqrt(((lifted[own] - lifted[vantage]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        perm[a:b] = own[by]
        half = (b - a) // 2
        median = float(d[by[half - 1]])
        if d[by[0]] == d[by[-1]]:
            return at                       # all at one distance: nothing to split by
        inner = grow(a, a + half)
        outer = grow(a + half, b)
        nodes[at] = (vantage, median, inner, outer, a, b)
        return at

    grow(0, len(points))
    return {"points": points, "lifted": lifted, "perm": perm, "nodes": nodes,
            "ids": np.concatenate(lists), "starts": np.cumsum([0] + [len(x) for x in lists]),
            "square": float(square.max())}


class _Best:
    """The best points of each query so far, by product, then index."""

    def __init__(self, queries: int, keep: int):
        self.product = np.full((queries, keep), -np.inf)
        self.point = np.full((queries, keep), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, products: np.ndarray, points: np.ndarray):
        """Products [rows, points] of some queries with some points."""
        hit = (~(products < self.product[rows, -1:])).any(1)
        rows, products = rows[hit], products[hit]
        if not len(rows):
            return
        products = np.where(np.isnan(products), -np.inf, products)
        p = np.concatenate([self.product[rows], products], 1)
        i = np.concatenate([self.point[rows], np.broadcast_to(points, products.shape)], 1)
        order = np.lexsort((i, -p), axis=1)[:, :self.product.shape[1]]
        self.product[rows] = np.take_along_axis(p, order, 1)
        self.point[rows] = np.take_along_axis(i, order, 1)


def find(index: dict, qids: np.ndarray, q: np.ndarray, k: int, factor: float = FACTOR):
    with np.errstate(over="ignore", invalid="ignore"):
        return _find(index, qids, q, k, factor)


def _find(index: dict, qids: np.ndarray, q: np.ndarray, k: int, factor: float):
    points, lifted, perm, nodes = index["points"], index["lifted"], index["perm"], index["nodes"]
    keep = k + 1 + SPARE                     # the query's own vector may be among them
    best = _Best(len(q), keep)
    base = (q * q).sum(1) + index["square"]
    slack = 1e-9 * (1.0 + base)
    ends = np.array([[n[4], n[5]] for n in nodes])
    opened = np.full(len(q), -1)             # the leaf each query went through first

    def radius(rows):
        # distance of the k-th best point so far
        return np.sqrt(np.maximum(base[rows] - 2 * best.product[rows, -1], 0.0) + slack[rows])

    def to(rows, point):
        return np.sqrt(np.maximum(base[rows] - 2 * (q[rows] @ points[point]), 0.0))

    def leaf(rows, node):
        own = np.sort(perm[ends[node, 0]:ends[node, 1]])
        best.offer(rows, q[rows] @ points[own].T, own)

    measured = np.isfinite(base)
    for a in range(0, len(points), LEAF):    # where distances are infinite: all points
        own = np.arange(a, min(a + LEAF, len(points)))
        rows = np.flatnonzero(~measured)
        if len(rows):
            best.offer(rows, q[rows] @ points[own].T, own)
    todo = [(0, np.flatnonzero(measured))]
    while todo:                              # down to each query's own leaf
        node, rows = todo.pop()
        vantage, median, inner, outer, _, _ = nodes[node]
        if inner < 0:
            leaf(rows, node)
            opened[rows] = node
            continue
        near = to(rows, vantage) <= median
        for child, own in ((inner, rows[near]), (outer, rows[~near])):
            if len(own):
                todo.append((child, own))
    todo = [(0, np.flatnonzero(measured))]
    while todo:                              # the whole tree, as far as it can matter
        node, rows = todo.pop()
        vantage, median, inner, outer, _, _ = nodes[node]
        if inner < 0:
            rows = rows[opened[rows] != node]
            if len(rows):
                leaf(rows, node)
            continue
        d, t = to(rows, vantage), factor * radius(rows)
        for child, own in ((outer, rows[d + t >= median]), (inner, rows[d - t <= median])):
            if len(own):
                todo.append((child, own))
    return _rows(index, qids, q, best, k)


def _rows(index, qids, q, best: _Best, k: int):
    """Exact scores of the kept points, spread over their ids, k per query."""
    at, j = np.nonzero(best.point < np.iinfo(np.int64).max)
    point = best.point[at, j]
    many = np.minimum(np.diff(index["starts"])[point], k + 1)
    score = np.zeros(len(at))
    for d in range(q.shape[1]):              # in component order: equal vectors give equal scores
        score += q[at, d] * index["points"][point, d]
    score[np.isnan(score)] = -np.inf
    at, score = np.repeat(at, many), np.repeat(score, many)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    ids = index["ids"][np.repeat(index["starts"][:-1][point], many) + offset]
    other = ids != qids[at]
    at, score, ids = at[other], score[other], ids[other]
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    top = place < k
    return qids[at[top]], ids[top], score[top]


def neighbours(emb: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, **sizes) -> DataFrame:
    rows = usable(emb).filter(F.exists("v", lambda x: x != 0))
    return search(rows, every, k, build, lambda i, ids, q, n: find(i, ids, q, n, factor), "double", **sizes)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


#: exact search; the approximate one agrees with it on the small tables (see tests)
OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

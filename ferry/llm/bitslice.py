"""Exact top-k by inner product over a bit-sliced index.

Each component x becomes floor(64 * x). Per shard, attribute d is stored as
bit slices: slice j is a bitmap over the rows holding bit j of x_d minus the
smallest x_d. For a query, every slice is added with the weight of the query's
bits by bitmap arithmetic: partial products are ANDs of a slice with the
query's bit, columns of equal weight are reduced three to two by carry-save
adders, and a ripple adds what is left, for a block of queries at once. A
negative query component uses the complement of the slices, so all sums are
non-negative and a constant per query restores the score.

The result slices are searched from the most significant down: rows with the
bit set either all fit into the k best, or only they remain in question. What
is still undecided at the end has equal scores; those boundary rows go by the
smaller id (rows are kept in id order). Scores are read off the slices, so the
result is exact.

Defined cases: vectors null, empty or with null or non-finite components, and
rows without id, take no part; a row is never a candidate of a query with its
own id; repeated rows are candidates each; zero vectors count (score 0);
fewer than k candidates: all of them; empty table: empty result. Rows and
queries with a component too large for 62-bit sums of slices (beyond 2^21 at 64
dimensions) are kept apart and scored exactly in whole numbers of any size; a
score outside the range of a long counts as, and is returned as, the nearest long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.common import table
from ferry.llm.vectors import search, usable

SCALE = 64
K = 20
EVERY = 20
BLOCK = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


LONG = (-(1 << 63), (1 << 63) - 1)


def quantise(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64)


def wide(v: np.ndarray) -> np.ndarray:
    """The rows with a component that slices cannot add up: |q| < 2^b and slices of
    b + 1 bits give sums below dimensions x 2^(2b + 2)."""
    bits = (60 - (v.shape[1] - 1).bit_length()) // 2
    return np.abs(np.floor(SCALE * np.clip(v, -1e300, 1e300))).max(1, initial=0) >= 2.0 ** bits


def whole(v: np.ndarray) -> list[list[int]]:
    """Components as whole numbers of any size (64 x is exact, being a power of two)."""
    from fractions import Fraction
    return [[(Fraction(x) * SCALE).__floor__() for x in row] for row in v.tolist()]


def _exact(queries: list[list[int]], rows: list[list[int]]) -> list[list[int]]:
    return [[min(max(sum(a * b for a, b in zip(q, x)), LONG[0]), LONG[1]) for x in rows] for q in queries]


def build(ids: np.ndarray, v: np.ndarray) -> dict:
    large = wide(v)
    if large.any():
        return {**build(ids[~large], v[~large]), "wide_ids": ids[large], "wide": whole(v[large])}
    if not len(v):
        return {"ids": ids, "low": np.zeros(v.shape[1], np.int64), "widths": np.zeros(v.shape[1], np.int64),
                "planes": np.zeros((0, 0), np.uint64)}
    x = quantise(v)
    n, dim = x.shape
    low = x.min(0)
    u = x - low
    widths = np.array([int(m).bit_length() for m in u.max(0)])
    planes = np.zeros((int(widths.sum()), -(-n // 64)), np.uint64)
    at = 0
    for d in range(dim):
        for j in range(widths[d]):
            bits = np.packbits(((u[:, d] >> j) & 1).astype(np.uint8), bitorder="little")
            planes[at].view(np.uint8)[:len(bits)] = bits
            at += 1
    return {"ids": ids, "low": low, "widths": widths, "planes": planes}


class _Columns:
    """Bitmaps waiting to be added, by weight."""

    def __init__(self):
        self.at: dict[int, list[np.ndarray]] = {}

    def add(self, weight: int, plane: np.ndarray):
        while True:
            own = self.at.setdefault(weight, [])
            own.append(plane)
            if len(own) < 3:
                return
            c, b, a = own.pop(), own.pop(), own.pop()
            x = a ^ b
            own.append(x ^ c)
            x &= c
            a = a & b
            a |= x
            weight, plane = weight + 1, a

    def total(self) -> list[np.ndarray]:
        """The sum's slices, from weight 0 up."""
        out, carry, w = [], None, 0
        while w <= max(self.at, default=-1) or carry is not None:
            own = self.at.get(w, []) + ([carry] if carry is not None else [])
            carry = None
            if len(own) == 3:
                a, b, c = own
                x = a ^ b
                out.append(x ^ c)
                carry = (a & b) | (x & c)
            elif len(own) == 2:
                out.append(own[0] ^ own[1])
                carry = own[0] & own[1]
            else:
                out.append(own[0] if own else None)
            w += 1
        return out


def _sum(index: dict, q: np.ndarray):
    """Slices [queries, words] of the shifted scores, and the shift of each query."""
    size, negative = np.abs(q), q < 0
    top = (np.int64(1) << index["widths"].astype(np.int64)) - 1
    shift = q @ index["low"] - np.where(negative, size, 0) @ top
    flip = np.where(negative, ONES, np.uint64(0))
    columns, at = _Columns(), 0
    for d, width in enumerate(index["widths"]):
        bits = [b for b in range(int(size[:, d].max()).bit_length())]
        chosen = [np.where((size[:, d] >> b) & 1, ONES, np.uint64(0))[:, None] for b in bits]
        for j in range(width):
            signed = index["planes"][at][None, :] ^ flip[:, d][:, None]
            for b in bits:
                columns.add(b + j, signed & chosen[b])
            at += 1
    return columns.total(), shift


def _select(slices, allowed: np.ndarray, k: int):
    """Bitmaps of the rows that are surely in and of those tied at the boundary, and how many of them."""
    inside = np.zeros_like(allowed)
    open_ = allowed.copy()
    have = np.zeros(len(allowed), np.int64)
    for s in reversed(slices):
        if s is None:
            continue
        ones = open_ & s
        n = have + np.bitwise_count(ones).sum(1, dtype=np.int64)
        over = (n > k)[:, None]
        inside = np.where(over, inside, inside | ones)
        have = np.where(n > k, have, n)
        open_ = np.where(over, ones, open_ & ~s)
    return inside, open_, have


def _values(index: dict) -> list[list[int]]:
    """The sliced rows' components, read off the slices."""
    n, x, at = len(index["ids"]), np.tile(index["low"], (len(index["ids"]), 1)), 0
    for d, width in enumerate(index["widths"]):
        for j in range(width):
            bits = np.unpackbits(index["planes"][at].view(np.uint8), bitorder="little")[:n]
            x[:, d] += bits.astype(np.int64) << j
            at += 1
    return x.tolist()


def find(index: dict, qids: np.ndarray, v: np.ndarray, k: int):
    """The k best of a shard: sliced rows by slices, wide rows and queries exactly."""
    large = wide(v)
    if not large.any() and "wide" not in index:
        return _find(index, qids, v, k)
    found = [*map(list, _find(index, qids[~large], v[~large], k))]
    pairs = [(qids[~large], whole(v[~large]) if "wide" in index else [], index.get("wide_ids", []), index.get("wide", []))]
    if large.any():
        own = whole(v[large])
        pairs += [(qids[large], own, index["ids"], _values(index)),
                  (qids[large], own, index.get("wide_ids", []), index.get("wide", []))]
    for asked, queries, ids, rows in pairs:
        for qid, scores in zip(asked, _exact(queries, rows)):
            best = sorted((-s, i) for s, i in zip(scores, ids) if i != qid)[:k]
            found[0] += [qid] * len(best)
            found[1] += [i for _, i in best]
            found[2] += [-s for s, _ in best]
    own, ids, scores = (np.array(c, np.int64) for c in found)
    order = sorted(range(len(own)), key=lambda i: (own[i], -int(scores[i]), ids[i]))
    own, ids, scores = own[order], ids[order], scores[order]
    top = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[top], ids[top], scores[top]


def _find(index: dict, qids: np.ndarray, v: np.ndarray, k: int):
    ids, n = index["ids"], len(index["ids"])
    if not n or not len(qids):
        return [np.zeros(0, np.int64)] * 3
    q = quantise(v)
    words = index["planes"].shape[1] if len(index["planes"]) else -(-n // 64)
    valid = np.zeros(words * 8, np.uint8)
    valid[:-(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    out = [[], [], []]
    for a in range(0, len(qids), BLOCK):
        own, qq = qids[a:a + BLOCK], q[a:a + BLOCK]
        allowed = np.repeat(valid.view(np.uint64)[None, :], len(own), 0)
        first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        for i, (x, y) in enumerate(zip(first, last)):
            for row in range(x, y):
                allowed[i, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        slices, shift = _sum(index, qq)
        inside, tied, have = _select(slices, allowed, k)
        for i in range(len(own)):
            rows = _rows(inside[i], n)
            if have[i] < k:
                rows = np.concatenate([rows, _rows(tied[i], n)[:k - have[i]]])
            score = np.full(len(rows), shift[i], np.int64)
            for p, s in enumerate(slices):
                if s is not None:
                    score += ((s[i][rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
            order = np.lexsort((rows, -score))
            out[0].append(np.full(len(rows), own[i]))
            out[1].append(ids[rows[order]])
            out[2].append(score[order])
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(bitmap).view(np.uint8), bitorder="little")[:n])


def top_k(emb: DataFrame, k: int = K, every: int = EVERY, **sizes) -> DataFrame:
    return search(usable(emb), every, k, build, find, "long", **sizes)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Vector searches against brute force."""
from fractions import Fraction

import numpy as np
import pytest

from ferry.llm import bitslice, vptree
from ferry.llm.vectors import search, usable

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dim string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute(rows, k, every, score, zero_ok):
    rows = [(i, v) for i, v in rows if i is not None and fine(v) and (zero_ok or any(v))]
    out = []
    for q, qv in sorted({i: v for i, v in rows if i % every == 0}.items()):
        own = sorted((-score(qv, v), i) for i, v in rows if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    return out


def int_score(a, b):
    f = lambda x: int(np.floor(64 * float(np.float32(x))))
    return sum(f(x) * f(y) for x, y in zip(a, b))


def float_score(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def awkward():
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.standard_normal(8) * 0.3]) for i in r.choice(10000, 150, False)]
    hot = [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, -0.25]
    rows += [(20000 + i, hot) for i in range(90)]                       # one vector many times
    rows += [(30000 + i, [float((i >> b) & 1) for b in range(8)]) for i in range(60)]   # many ties, one zero vector
    rows += [(40, None), (60, []), (80, [None] * 8), (100, [float("nan")] + [0.0] * 7), (120, [float("inf")] + [0.0] * 7),
             (None, hot), (140, [0.0] * 8), (160, [1.0, 2.0, 3.0]), (181, [3.0, 2.0, 1.0])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "chunk_queries": 5}])
def test_bit_slices_are_exact(spark, sizes):
    rows = awkward()
    got = bitslice.top_k(table(spark, rows), k=20, every=20, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 20, int_score, True)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "chunk_queries": 5}])
def test_trees_are_exact_at_factor_one(spark, sizes):
    rows = awkward()
    got = vptree.neighbours(table(spark, rows), k=20, every=20, factor=1.0, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 20, float_score, False)


def test_deep_tree_is_exact_and_relaxed_recall_is_high():
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 16))
    v = centres[r.integers(0, 40, 3000)] + 0.3 * r.standard_normal((3000, 16))
    ids = np.arange(3000)
    index = vptree.build(ids, v)
    q = ids[::30]
    exact = vptree.find(index, q, v[q], 20, 1.0)
    near = vptree.find(index, q, v[q], 20, vptree.FACTOR)
    products = v[q] @ v.T
    products[np.arange(len(q)), q] = -np.inf
    want = np.argsort(-products, 1)[:, :20]
    hit = lambda res: np.mean([len(set(res[1][res[0] == x]) & set(w)) / 20 for x, w in zip(q, want)])
    assert hit(exact) == 1.0 and hit(near) >= 0.9


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 20, float_score, False)}
    got = {(r.query_id, r.vec_id) for r in vptree.op6(spark, d).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_few_rows_and_empty_tables(spark):
    one = [(20, [1.0, 0.0]), (41, [0.5, 0.5])]
    assert [tuple(r) for r in bitslice.top_k(table(spark, one)).collect()] == [(20, 1, 41, 2048)]
    assert [tuple(r) for r in vptree.neighbours(table(spark, one)).collect()] == [(20, 1, 41, 0.5)]
    assert bitslice.top_k(table(spark, [])).count() == vptree.neighbours(table(spark, [])).count() == 0


def test_repeated_ids_are_one_query_and_many_candidates(spark):
    rows = [(20, [1.0]), (20, [2.0]), (21, [1.0]), (21, [1.0])]
    got = search(usable(table(spark, rows)), 20, 5, bitslice.build, bitslice.find, "long").collect()
    assert sorted(map(tuple, got)) == [(20, 1, 21, 8192), (20, 2, 21, 8192)]


def clipped(a, b):
    f = lambda x: (Fraction(x) * 64).__floor__()
    return min(max(sum(f(x) * f(y) for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1)


def test_large_components_are_scored_exactly(spark):
    """Components that slices cannot add up, in rows and in queries, next to small ones."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.integers(-9, 9, 4) / 8]) for i in range(60)]
    rows += [(100 + i, [1e9 * (i - 3), 2.0 ** 40, -0.3, 1e30 if i % 3 == 0 else 0.5]) for i in range(9)]
    rows += [(120, [1e9, -1e9, 1.0, 0.0]), (140, [1e300, 0.0, 0.0, -1e300]), (160, [0.0, 3e7, 0.0, 0.25])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 7, 20, clipped, True)
    for sizes in ({}, {"shard_rows": 10, "chunk_queries": 2}):
        assert sorted(map(tuple, bitslice.top_k(df, k=7, every=20, **sizes).collect())) == want


def test_infinite_products_rank(spark):
    rows = [(20, [1e200, 0.0]), (21, [1e200, 0.0]), (22, [1.0, 0.0]), (23, [-1e200, 5.0]), (40, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vptree.neighbours(df, k=5, every=20).collect()))
    inf = float("inf")
    assert got == [(20, 1, 21, inf), (20, 2, 22, 1e200), (20, 3, 40, 5e199), (20, 4, 23, -inf),
                   (40, 1, 20, 5e199), (40, 2, 21, 5e199), (40, 3, 22, 0.5), (40, 4, 23, -5e199)]


def test_an_index_is_moved_once_while_the_queries_fit_one_chunk(spark):
    from ferry.llm import vectors
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(600)]
    got = vptree.neighbours(table(spark, rows), k=3, every=20, shard_rows=100).collect()
    assert len(got) == 90 and vectors.BLOCK_BYTES // (8 * 8) > 600

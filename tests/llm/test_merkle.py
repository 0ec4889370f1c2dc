"""The manifest against trees built in plain Python, and bitmap ranks against counting."""
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import merkle
from tests.llm.cases import AWKWARD, DOCS, docs


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    """(others before, others behind) of every run on the way up."""
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1:first + 3]))
        i //= 3
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = build([leaf(*r) for r in by[s]])
    top = build([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = way(trees[s], i) + way(top, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if hit else leaf(*r)
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), node,
                        node == top[-1][0]))
    return out


def key(r):
    return tuple(str(x) for x in r)


def check(spark, rows, df=None, **kw):
    df = docs(spark, rows) if df is None else df
    out = [tuple(r) for r in merkle.manifest(df, **kw).collect()]
    own = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    assert sorted(out, key=key) == sorted(plain(own), key=key)
    return out


def test_sizes_around_every_power_of_three(spark):
    rows = [(1000 * n + i * 7, f"text {i}\nline", "en", f"s{n}") for n in (1, 2, 3, 4, 8, 9, 10, 27, 28) for i in range(n)]
    out = check(spark, rows)
    assert any(r[-1] for r in out) and not all(r[-1] for r in out)


def test_several_arrays_and_containers(spark):
    r = np.random.default_rng(4)
    ids = sorted({*range(150), *map(int, r.integers(-2 ** 63, 2 ** 63 - 1, 120)), -1, -4096, 2 ** 63 - 1, -2 ** 63, 4095, 4096})
    rows = [(i, "a\nb" if k % 3 else "ab", "en", "hot" if k % 2 else None) for k, i in enumerate(ids)]
    rows += [(7, "a\nb", "en", f"s{k:02d}é") for k in range(40)]     # more sources than one array holds
    check(spark, rows, span=2)


def test_repeated_and_missing_ids(spark):
    rows = [(5, "same\n", "en", "a")] * 11 + [(5, f"other\n{i}", "en", "a") for i in range(5)] + [(5, "same\n", "en", "b")] * 2
    rows += [(None, "none\n", "en", "a")] * 4 + [(None, f"none {i}", None, "a") for i in range(6)] + [(4, "x", "en", "a"), (6, "x", "en", "a")]
    check(spark, rows, docs(spark, rows).repartition(5), span=1)


def test_a_source_of_more_rows_than_16_bits_count(spark):
    check(spark, [(i, "t\n", "en", "a") for i in range(70000)])


def test_many_rows_without_id(spark):
    rows = [(None, f"t{i}\n", "en", "a") for i in range(9000)] + [(i, "t", "en", "a") for i in range(70)]
    check(spark, rows)


def test_awkward_and_empty_tables(spark):
    check(spark, AWKWARD)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_any_change_shows(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(30)]
    root = merkle.manifest(docs(spark, rows)).first().root
    for changed in ([*rows[:-1], (29, "t29", "de", "s2")], rows[:-1], [(30, *rows[0][1:]), *rows[1:]]):
        assert merkle.manifest(docs(spark, changed)).first().root != root


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 4095), min_size=1, max_size=600), st.data())
def test_ranks(ids, data):
    packed = merkle.pack_ids(np.array(sorted(ids)))
    assert len(packed) <= 513
    words = merkle.unpack_bits(packed)
    asked = np.array(data.draw(st.lists(st.integers(0, 4095), min_size=1, max_size=50)))
    got = merkle.rank(words, merkle.directory_of(words), asked)
    assert got.tolist() == [sum(i < a for i in ids) for a in asked.tolist()]


@pytest.mark.parametrize("n", [1, 2, 3, 26, 27, 28, 100])
def test_fold_gives_the_root(n):
    nodes = [h(str(i)) for i in range(n)]
    levels = build(nodes)
    for i in range(n):
        assert merkle.fold(nodes[i], i, n, [x for a, b in way(levels, i) for x in (*a, *b)]) == levels[-1][0]

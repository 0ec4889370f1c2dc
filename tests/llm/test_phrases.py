"""Phrases against plain counting, and the sort against numpy's."""
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import phrases
from tests.llm.cases import AWKWARD, docs


def plain(rows, least, top=2000, covered=50):
    f, n = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(100 * b >= covered * a for (x, q), b in f.items()
                               if x == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
            continue
        cuts = [(10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def run(spark, rows, least=10, **kw):
    out = phrases.collocations(docs(spark, rows), least=least, **kw)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def sample(seed, n=300):
    r = np.random.default_rng(seed)
    words = ["a", "b", "the", "The", "x\x00y", "é", "漢字", "w" * 300, "ab", "a\x1fb", "q-r"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", "?!", ",", "\x0b"]
    return [(i, "".join(words[min(int(r.zipf(1.5)), 11) - 1] + ends[r.integers(len(ends))] for _ in range(r.integers(40))),
             [None, "und", "en", "de"][r.integers(4)], "s") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counting(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 300)      # many blocks a task
    rows = sample(seed)
    assert run(spark, rows, 10) == plain(rows, 10)
    assert run(spark, rows, 3, top=7) == plain(rows, 3, 7)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", (8, 8))
    rows = sample(3)
    monkeypatch.setattr(phrases.Alive, "of", staticmethod(lambda level, n: phrases.Alive(np.full(16, 255, np.uint8))))
    assert run(spark, rows, 10) == plain(rows, 10)


def test_awkward_and_empty_tables(spark):
    rows = AWKWARD * 10
    assert run(spark, rows) == plain(rows, 10)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None)]) == []


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(4 * 10 ** 12, 5 * 10 ** 12, 7 * 10 ** 12)], "a long, l long, r long")
    a, left, right = 4 * 10 ** 12, 5 * 10 ** 12, 7 * 10 ** 12
    assert row.select(phrases._score("a", "l", "r").alias("s")).first().s == 10 ** 6 * a * a // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.integers(0, 400), st.integers(1, 12), st.integers(1, 20), st.integers(0, 10 ** 6))
def test_equal_partitions(depth, n, words, least, seed):
    r = np.random.default_rng(seed)
    keys = r.integers(0, words, (depth, n)).astype(np.int32)
    weight = r.integers(1, 9, n)
    old, phrases.SMALL = phrases.SMALL, int(r.integers(0, 40))
    try:
        heads, sizes = phrases.equal_partitions(keys, weight, least)
    finally:
        phrases.SMALL = old
    want = Counter()
    for i in range(n):
        want[tuple(keys[:, i])] += int(weight[i])
    assert {tuple(keys[:, h]): int(s) for h, s in zip(heads, sizes)} == {k: v for k, v in want.items() if v >= least}
    assert len(heads) == len(set(heads.tolist()))

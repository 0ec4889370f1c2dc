"""Near-duplicates against brute force, also with tiny regions, groups and blocks."""
import random

import numpy as np
import pytest

from ferry.llm import neardup
from ferry.llm.components import components
from tests.llm.cases import AWKWARD, docs


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing everything."""
    sets = []
    for i, t in rows:
        w = (t or "").encode("utf-8").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    parent[root(a)] = root(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[root(a)] = min(least.get(root(a), rows[a][0]), rows[a][0])
    return sorted([(r[0], len(s), least[root(a)] if r[0] is not None else None) for a, (r, s) in enumerate(zip(rows, sets))],
                  key=repr)


def corpus(seed, groups=25, hot=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(hot if g == 0 else rnd.randint(1, 4)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                own[rnd.randrange(len(own))] = word()
            rows.append((i, rnd.choice([" ", "\n", "  "]).join(own).upper() if rnd.random() < .2 else " ".join(own)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shingles", [(1, None), (2, 2000), (3, 300)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, shingles):
    if shingles:
        monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles)
    rows = corpus(seed) + [(r[0] if r[0] is None else 5000 + r[0], r[1]) for r in AWKWARD]
    got = neardup.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_shuffled_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_MEMBERS", 0)
    rows = corpus(4, groups=10)
    got = neardup.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_empty_table(spark):
    assert neardup.classes(docs(spark, [])).count() == 0


def test_stage_keeps_one_of_each(spark):
    rows = corpus(5, groups=8, hot=10)
    kept = neardup.keep_one(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, n, c in plain(rows)})


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z0", f"z{i}") for i in range(1, 30)] + [("q", "q")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[f"n{i:03d}"] for i in range(61)}) == 1 and len({got[f"z{i}"] for i in range(30)}) == 1
    assert got["n000"] != got["z0"]


def test_region_wider_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STRETCH", 8)
    rows = corpus(6, groups=3, hot=80)
    got = neardup.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def boilerplate(seed, members, shared, own, pairs):
    """A family that shares most of its text (pairs of it below the threshold), in which a few pairs are near copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(7))
    common = [word() for _ in range(shared)]
    rows = [(i, " ".join(common + [word() for _ in range(own)])) for i in range(members)]
    for k in range(pairs):
        words = rows[k][1].split()
        words[-1 - k % 5] = word()
        rows.append((members + k, " ".join(words)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch", [1024, 64])
def test_boilerplate_family(spark, monkeypatch, stretch):
    """Every region is above REGION; with a small STRETCH all are cut deeper, over many seams."""
    monkeypatch.setattr(neardup, "STRETCH", stretch)
    rows = boilerplate(7, 600, 150, 50, 60)
    got = neardup.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def deep(seed, n, same):
    """Sorted deep labels of one region: signatures that agree with one another in about ``same`` of all hashes."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, neardup.HASHES, dtype=np.uint8)
    low = np.where(rng.random((n, neardup.HASHES)) < same, base, rng.integers(0, 256, (n, neardup.HASHES), dtype=np.uint8))
    low[:, :neardup.DEPTH] = base[:neardup.DEPTH]
    out = np.zeros((n, neardup._DEEP), np.uint8)
    out[:, neardup._LABEL:] = low
    return out[np.lexsort(out.T[::-1])]


@pytest.mark.parametrize("same", [0.7, 0.8, 0.9])
def test_links_of_a_region_hold_together_what_all_pairs_would(same):
    labels = deep(3, 300, same)
    low = labels[:, neardup._LABEL:]
    agree = (low[:, None] == low[None]).sum(2) >= neardup.LEAST_EQUAL

    def groups(links):
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for i, j in links:
            assert agree[i, j]
            parent[root(i)] = root(j)
        return [min(k for k in range(300) if root(k) == root(x)) for x in range(300)]

    assert groups(neardup.region_links(labels, 300)) == groups(zip(*np.nonzero(agree)))


def test_equal_signatures_are_chained():
    labels = np.repeat(deep(4, 1, 1.0), 50, axis=0)
    assert sorted(neardup.region_links(labels, 8)) == [(i, i + 1) for i in range(49)]


def test_regions_over_seams_and_batches():
    """Small regions give pairs; large ones, and those at a partition's borders, their rows."""
    import pyarrow as pa
    rows = [(b"f", b"0")] + [(b"g", bytes([i])) for i in range(3)] + [(b"h", bytes([i])) for i in range(6)] + [(b"i", b"9")]
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[a:a + 2]], pa.binary()),
                                           pa.array([n for _, n in rows[a:a + 2]], pa.binary())], ["label", "node"])
               for a in range(0, len(rows), 2)]
    out = [r for b in neardup._regions(4)(batches) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["b"]} == {(b"\0", b"\1"), (b"\0", b"\2"), (b"\1", b"\2")}
    assert sorted((r["label"], r["a"]) for r in out if not r["b"]) == \
        [(b"f", b"0")] + [(b"h", bytes([i])) for i in range(6)] + [(b"i", b"9")]

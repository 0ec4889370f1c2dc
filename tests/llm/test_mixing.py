"""Water-filling against the iterative definition, and the mix's totals."""
import pytest

from ferry.llm import mixing
from tests.llm.cases import AWKWARD, docs


def filled(sizes, weights, budget, cap):
    """sizes in source order -> targets, by clamping and sharing again."""
    total = budget * sum(sizes)
    clamped, target = set(), [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        rest = [i for i in range(len(sizes)) if i not in clamped]
        left = total - sum(cap * sizes[i] for i in clamped)
        share = sum(w[i] for i in rest)
        for i in range(len(sizes)):
            target[i] = cap * sizes[i] if i in clamped else left * w[i] / share
        over = {i for i in rest if target[i] > cap * sizes[i] * (1 + 1e-12)}
        if not over:
            return target
        clamped |= over


def check(spark, rows, **kw):
    out = mixing.mix(docs(spark, rows), **kw).collect()
    assert len(out) == len(rows)
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    size = {s: sum(len((t or "").encode().split()) for _, t, _, x in rows if x == s) for s in sources}
    want = filled([size[s] for s in sources], kw.get("weights", mixing.WEIGHTS), kw.get("budget", 1.5), kw.get("max_epochs", 2))
    by_size = {}
    for s, t in zip(sources, want):
        by_size[size[s]] = t
    taken = {}
    for r in out:
        assert 0 <= r.taken <= kw.get("max_epochs", 2) * r.size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        assert r.target == pytest.approx(by_size[r.source_size], rel=1e-9, abs=1e-9)
    return taken, by_size, out


def test_targets_and_totals(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(600)]
    taken, want, out = check(spark, rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_awkward_table(spark):
    check(spark, AWKWARD + [(50, "x y z", "en", "é"), (51, None, "en", "zero")])


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_shuffled_rates(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    check(spark, [(i, "w " * (i % 9), "en", f"s{i % 4}") for i in range(100)])


def test_stage_takes_what_the_mix_says(spark):
    rows = [(i, f"w{i} " * (1 + i * 7 % 50), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(200)]
    d = docs(spark, rows)
    words = {}
    for r in mixing.mix_stage(spark, d, "").collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    for r in mixing.mix(d).collect():
        assert words.get(r.doc_id, 0) == r.taken


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix(docs(spark, AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

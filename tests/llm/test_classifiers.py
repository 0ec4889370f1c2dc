"""Language ID and toxicity: held-out accuracy, awkward tables, gradients."""
import zlib

import numpy as np
import pytest

from ferry.llm import langid, toxicity
from ferry.llm.gru import BiGRU, index
from tests.llm.cases import AWKWARD, docs


def test_language_accuracy_on_held_out(spark):
    got = langid.op4(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark):
    d = docs(spark, AWKWARD + [(100 + i, "the cat and the dog" * 3, "en", "a") for i in range(20)]
             + [(200 + i, "le chat et le chien" * 3, "fr", "a") for i in range(20)])
    out = langid.predict(d.select("doc_id", "text"), langid.train(d)).collect()
    assert len(out) == len(AWKWARD) + 40
    by = {r.doc_id: r for r in out}
    for i in (1, 2, 3, 8, 9):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[100].lang_pred == "en" and by[200].lang_pred == "fr"


def test_language_that_is_rare_is_learned(spark):
    rows = [(i, "the cat and the dog went home " * 2, "en", "a") for i in range(6000)] \
        + [(10_000 + i, "le chat et le chien sont ici " * 2, "fr", "a") for i in range(8)] \
        + [(20_000 + i, "hunden og katten er ude nu", "da", "a") for i in range(1)]
    d = docs(spark, rows)
    model = langid.train(d, 40)
    assert model.langs == ["da", "en", "fr"]
    assert model.predict("le chien et le chat sont ici")[0] == "fr"
    assert model.predict("the dog and the cat went home")[0] == "en"


def test_language_empty_and_unlabelled(spark):
    empty = docs(spark, [])
    assert langid.predict(empty.select("doc_id", "text"), langid.train(empty)).count() == 0
    d = docs(spark, [(1, "some text", None, "a")])
    assert langid.predict(d.select("doc_id", "text"), langid.train(d)).first().lang_pred == "und"


def test_what_a_letter_is():
    assert langid.has_letter("1 a") and langid.has_letter("漢") and langid.has_letter("é")
    assert not any(map(langid.has_letter, ("", "²³", "123 _!", "١٢")))


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = rng.standard_normal((400, 3))
    z[np.arange(400), y] += 1
    t = langid.fit_temperature(8 * z, y)
    loss = lambda u: (np.log(np.exp(u).sum(1)) - u[np.arange(400), y]).mean()
    assert t > 2 and loss(8 * z / t) < loss(8 * z)


def test_l1_leaves_most_weights_at_zero():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 10 + int(rng.integers(1000))]), np.array([1, 1], np.float32), y) for y in (0, 1) * 200]
    w, _ = langid.ftrl(rows, 2, l1=0.5)
    assert abs(w[0, 0]) > 0 and (w[10:] == 0).mean() > 0.9


def test_gru_gradients():
    net = BiGRU()
    words, ids, mask = index([["a", "b", "c"], ["b"], ["c", "a"]])
    y, weight = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    for name in ("Wf", "Ub", "bf", "A", "v", "o", "c"):
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        net.p["v"] += 0.3

    def loss():
        z, _ = net.forward(net.gate_inputs(net.embed(words).astype(np.float64)), ids, mask)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    gates = net.gate_inputs(net.embed(words).astype(np.float64))
    _, g, dgates = net.gradient(gates, ids, mask, y, weight)
    for name, at in (("Ub", (3, 5)), ("Uf", (2, 20)), ("A", (4, 2)), ("v", (1,)), ("o", (3,)), ("c", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert g[name].reshape(net.p[name].shape)[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 64, 65, 96, 97, 200, 1000):
        covered = np.zeros(n, int)
        for s in toxicity.starts(n):
            covered[s:s + toxicity.WINDOW] += 1
        assert (covered > 0).all()


def test_long_tokens_are_read_whole():
    for t in ("漢" * 100_000, "you_vile.fool-" * 50, "x" * 64, "x" * 65, "a " + "b" * 129 + " c", "é" * 63 + "_" + "é" * 63):
        own = toxicity.words(t)
        assert "".join(own) == t.lower().replace(" ", "") and max(map(len, own)) <= 64
    assert toxicity.words("a_" * 40 + "vile_fool")[-1].endswith("vile_fool")


def test_toxicity_inside_a_text_without_blanks(spark):
    clean, vile = "a_fine_day_for_all_of_us_", "you_vile_fool_you_vile_fool_"
    rows = [(i, clean * 12 + (vile * 4 if i % 2 else clean * 4) + clean * 12, "en", "a") for i in range(300, 400)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300, 400)], "doc_id long, toxic int")
    by = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert all(by[i] >= 0.5 for i in by if i % 2) and all(by[i] < 0.5 for i in by if not i % 2)


def long_text(i, passage=""):
    """2,400 harmless words (74 windows) of the row, with a passage in the middle."""
    rng = np.random.default_rng(i)
    own = [f"w{n}" for n in rng.integers(0, 400, 2400)]
    return " ".join(own[:1200] + passage.split() + own[1200:])


def test_toxicity_one_passage_in_long_texts(spark):
    rows = [(i, long_text(i, "you vile fool " * 12 if i % 2 else ""), "en", "a") for i in range(300, 420)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300, 420)], "doc_id long, toxic int")
    scorer = toxicity.train(docs(spark, rows), labels)
    new = [(i, long_text(i, "you vile fool " * 12 if i % 2 else "")) for i in range(1000, 1040)]
    got = scorer.scores([t for _, t in new])
    assert np.mean([(s >= 0.5) == i % 2 for s, (i, _) in zip(got, new)]) >= 0.95


def test_worst_window_is_that_of_scoring(spark):
    rows = [("k%d" % i, "d", 0, long_text(i) if i else " ") for i in range(4)]
    texts = spark.createDataFrame(rows, "key string, digest string, label int, text string")
    scorer = toxicity.Scorer(BiGRU(), 1.0, 0.0, 0.0)
    got = toxicity.windows(texts, scorer)
    whole = scorer.worst([toxicity.words(r[3]) for r in rows])
    assert [r[3] for r in got] == pytest.approx(list(whole[1:]), abs=1e-5) and whole[0] == -np.inf
    assert [r[3] for r in got] == pytest.approx(list(scorer.worst([r[4][0] for r in got])), abs=1e-5)


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op5(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic = [r for r in held if r.toxic == 1]
    clean = [r for r in held if r.toxic == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted for r in toxic]) >= 0.85
    assert np.mean([r.predicted for r in clean]) <= 0.05


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(300, 360)] + [(None, 1, "x"), (1, None, "x"), (999, 1, "x"),
                                                                              (301, 0, "x")],
                                   "doc_id long, toxic int, text string")
    d = docs(spark, AWKWARD + [(i, ("you vile fool " if i % 2 else "a fine day ") * 4, "en", "a") for i in range(300, 360)])
    out = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert len(out) == len(AWKWARD) + 60
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] == by[3] == 0.0 and all(0 <= r.score <= 1 for r in out)
    assert by[301] > by[300]
    none = toxicity.train(d, labels.filter("toxic = 1"))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0, 1.0}
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), labels)).count() == 0

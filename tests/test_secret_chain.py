"""The secret model scores every token in one chain."""

import numpy as np
import pytest

from ferry.llm import secret_scan as S


@pytest.fixture(scope="module")
def model():
    texts = ["the password: hunter22 was in the file", "def f(): return token", "a long line of prose with nothing in it"]
    return S.Model().fit(S.examples(texts))


def _texts():
    rng = np.random.default_rng(4)
    words = ["the", "of", "a", "prose", "file", "is", "it", "Key", "x=1;", "token", "--", "né", "2020-01-02"]
    out = ["", " ", "one", "two words"]
    for form in (*S._SECRETS, *S._PLAIN):
        left = " ".join(rng.choice(words, 30))
        out.append(f"{left} {S._fill(form, rng)} " + " ".join(rng.choice(words, 25)))
    return out


def test_labels_are_those_of_one_chain(model):
    some = 0
    for text in _texts():
        tokens = [m.span() for m in S._TOKEN.finditer(text)]
        if not tokens:
            assert model.spans(text, 0) == []
            continue
        x = S.features(text, tokens, S._file_names(text, 1))
        words = [text[a:b] for a, b in tokens]
        e = S._Known(model.crf.w).scores(words, S._file_names(text, 1))
        assert np.allclose(e, model.crf.emissions(x))
        whole = model.crf.decode(x, np.zeros(len(tokens), bool))
        y = model.labels(words, S._file_names(text, 1)) or [0] * len(words)
        assert y == whole.tolist()
        some += any(y)
    assert some > 5


def test_tokens_far_from_triggers_are_scored():
    # such tokens used to be outside whatever the model said of them
    text = "some words before qX7zz9Kdw and more of them behind it"
    assert not S.triggers(text)
    model = S.Model()
    shape = S._id(f"sh{S._shape('qX7zz9Kdw')}")
    model.crf.w[shape, 1] = 50.0
    assert [text[a:b] for _, a, b in model.spans(text, 0)] == ["qX7zz9Kdw"]


def test_only_runs_that_may_hold_secrets_are_decoded(model, monkeypatch):
    """The tagging is that of one chain, also where several runs are decoded apart."""
    rng, seen = np.random.default_rng(2), []
    own = S.best_tags
    monkeypatch.setattr(S, "best_tags", lambda e, *rest: seen.append(len(e)) or own(e, *rest))
    known, crf, total = S._Known(model.crf.w), model.crf, 0
    model.known = known
    for n in (1, 2, 3, 5, 40, 400):
        for shift in (0.0, 2.0, 6.0):
            e = rng.normal(0, 3, (n, 3)) + [shift, 0, 0]
            monkeypatch.setattr(known, "scores", lambda *_: e)
            y = model.labels(["w"] * n, []) or [0] * n
            assert y == own(e, crf.t + crf.barred, crf.start)
            total += n
    assert sum(seen) < total


def test_tokens_alike_have_one_row_and_the_scores_of_their_features(model):
    words = ["Hello", "Jolly", "www.a", "wwx.a", "abcde", "abcdg", "a=1", "a=x", "key_1", "kez_1", "Token", "TOKEN", "Tokem",
             "élan", "Ébc", "٣٣", "a1b2", "x1y2", "//ab", "a//b", "A.b.c", "A.bcd", "pwd", "pwx", "0" * 40, "f" * 40, "g" * 40]
    known = S._Known(model.crf.w)
    number = known.numbers(words)
    for w, n in zip(words, number):
        assert np.allclose(known.v[n, 0], known._sum(S._token_names(w))), w
        for k, side in enumerate("MLRS"):
            assert np.allclose(known.v[n, 1 + k], known._sum(S._word_names(w, side))), w
    assert known.numbers(["Jello", "Hello"]).tolist() == [number[0]] * 2

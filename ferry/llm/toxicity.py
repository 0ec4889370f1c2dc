"""Toxicity: a bidirectional GRU with attention pooling over overlapping windows.

Each text is cut into windows of ``WINDOW`` words, each starting half a window
after the last one and the final one ending with the text, so every word is
seen with context on both sides. A word is what stands between blanks; above
64 characters (unspaced scripts, text joined by marks) it is split into
consecutive pieces that are words of their own. The network (``gru``) scores every window
from character and word inputs; a document's score is that of its worst
window, calibrated by a logistic curve.

Labels belong to documents, so training is multiple-instance learning: each
round scores all windows of the training documents, in Spark tasks, and learns
from the worst one of each. At most ``train_docs`` toxic and twice as many clean
documents are used (smallest seeded hash), each of them whole; every fifth only
sets the calibration, on the worst of all its windows as in scoring. Labels,
lang, source and doc_id are never inputs.

Scoring runs in Arrow batches: the gate inputs of distinct words are computed
once and kept in a bounded per-worker cache, windows are scored in blocks of
fixed size, so memory does not follow text length.

Defined cases: a null text or one without words scores 0; null labels, null
ids and labels without a document are not learned from; a document labelled
twice counts as toxic if any label says so; with fewer than two labels
present every score is the share of toxic ones (0 if there are none); repeated
rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.common import seeded_key, ship, smallest, staged, table
from ferry.llm.gru import HIDDEN, BiGRU

WINDOW, STRIDE = 64, 32
TRAIN_DOCS = 600
#: rounds of training: fewer the more documents there are
ROUNDS, DOC_ROUNDS = (8, 20), 15_000
BLOCK = 1024
CACHE_WORDS = 200_000
SLICE_CHARS = 2_000_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»"
_LONGEST = 64
#: a piece of a longer token: to its end, else to the last mark in reach, else of full length
_PIECE = re.compile(rf".{{1,{_LONGEST}}}\Z|.{{0,{_LONGEST - 1}}}[\W_]|.{{1,{_LONGEST}}}", re.S)


def words(text: str) -> list[str]:
    """The words of a text; a token above 64 characters becomes several, none of it is left out."""
    tokens = text.lower().split()
    if max(map(len, tokens), default=0) <= _LONGEST:
        return tokens
    return [w for t in tokens for w in ((t,) if len(t) <= _LONGEST else _PIECE.findall(t))]


def cleaned(token: str) -> str:
    """A token as the network reads it: no punctuation at its edges."""
    return token.strip(_EDGE) or token


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words start."""
    if n <= WINDOW:
        return [0] if n else []
    out = list(range(0, n - WINDOW, STRIDE))
    return out + [n - WINDOW]


class Scorer:
    """The trained network with its calibration; scores lists of texts."""

    def __init__(self, net: BiGRU | None, slope: float, shift: float, prior: float):
        self.net, self.slope, self.shift, self.prior = net, slope, shift, prior
        self.reset()

    def reset(self):
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((0, 2, 3 * HIDDEN), np.float32)

    def __getstate__(self):
        return (self.net, self.slope, self.shift, self.prior)

    def __setstate__(self, state):
        self.net, self.slope, self.shift, self.prior = state
        self.reset()

    def _ids(self, tokens: list[list[str]]) -> list[np.ndarray]:
        new = [t for t in dict.fromkeys(t for own in tokens for t in own) if t not in self.rows]
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.reset()
            new = list(dict.fromkeys(t for own in tokens for t in own))
        if new:
            more = [self.net.gate_inputs(self.net.embed([cleaned(t) for t in new[i:i + 20_000]]))
                    for i in range(0, len(new), 20_000)]
            self.rows.update(zip(new, range(len(self.gates), len(self.gates) + len(new))))
            self.gates = np.concatenate([self.gates, *more])
        return [np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own)) for own in tokens]

    def _windows(self, tokens: list[list[str]]):
        """Owner, start and logit of every window of the texts."""
        ids = self._ids(tokens)
        whole = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        first = [starts(len(i)) for i in ids]
        owner = np.repeat(np.arange(len(ids)), [len(f) for f in first])
        first = np.concatenate([np.asarray(f, np.int64) + at[k] for k, f in enumerate(first)]) \
            if len(owner) else np.zeros(0, np.int64)
        z = np.zeros(len(owner), np.float32)
        size = np.minimum(at[owner + 1] - first, WINDOW)
        # windows of like size together: no steps are spent on padding
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), BLOCK):
            pick = order[k:k + BLOCK]
            width = int(size[pick].max())
            grid = first[pick][:, None] + np.arange(width)
            mask = np.arange(width) < size[pick][:, None]
            z[pick] = self.net.forward(self.gates, np.where(mask, whole[grid], 0), mask)[0]
        return owner, first - at[owner], z

    def worst(self, tokens: list[list[str]]) -> np.ndarray:
        """The largest window logit of each text (-inf without words)."""
        out = np.full(len(tokens), -np.inf)
        owner, _, z = self._windows(tokens)
        np.maximum.at(out, owner, z)
        return out

    def worst_windows(self, tokens: list[list[str]]) -> list[tuple[list[str], float]]:
        """The first window with the largest logit of each text with words, and that logit."""
        owner, first, z = self._windows(tokens)
        order = np.lexsort((-first, z, owner))
        top = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order
        return [(tokens[k][f:f + WINDOW], float(v)) for k, f, v in zip(owner[top], first[top], z[top])]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        tokens = [words(t or "") for t in texts]
        if self.net is None:
            return np.array([self.prior if t else 0.0 for t in tokens])
        z = self.slope * self.worst(tokens) + self.shift
        return np.where(np.isfinite(z), 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with a positive slope (Newton, lightly regularised)."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return (float(w[0]), float(w[1])) if w[0] > 0.05 else (1.0, 0.0)


def fit(labels: list[int], ends, look, rounds: int | None = None) -> Scorer:
    """Train on documents of these labels; every fifth sets the calibration.

    ``ends`` are the first and last window of each document, ``look(net)`` gives
    the worst of all its windows with that one's logit.
    """
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Scorer(None, 1.0, 0.0, float(y.mean()) if len(y) else 0.0)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        if len(own) >= 5:
            held[own[::5]] = True
    learn = np.flatnonzero(~held)
    net = BiGRU()
    rounds = rounds or int(np.clip(DOC_ROUNDS // len(learn), *ROUNDS))

    def read(windows):
        return [list(map(cleaned, w)) for w in windows]

    net.fit(read([ends[i][0] for i in learn] + [ends[i][1] for i in learn]), np.tile(y[learn], 2), epochs=1)
    for k in range(rounds):
        top = look(net)
        net.fit(read([top[i][0] for i in learn]), y[learn], epochs=1, seed=k)
    tune = np.flatnonzero(held) if held.any() else learn
    top = look(net)
    slope, shift = _logistic(np.array([top[i][1] for i in tune]), y[tune])
    return Scorer(net, slope, shift, 0.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Scorer:
    ship(docs.sparkSession)
    key = seeded_key(F.col("id"), "toxic")
    known = labels.select(F.col("doc_id").alias("id"), "toxic") \
        .filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id"))) \
        .groupBy("id").agg(F.max("toxic").alias("label")).withColumn("key", key)
    some = [smallest(known.filter(F.col("label") == y), n) for y, n in ((0, 2 * train_docs), (1, train_docs))]
    chosen = F.broadcast(staged(some[0].unionByName(some[1]), "toxic-sample"))   # at most 3 x train_docs rows
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL") \
        .join(chosen, F.col("doc_id") == F.col("id")) \
        .select("key", F.md5("text").alias("digest"), F.col("label").cast("int"), "text")
    # whole texts, dealt over all tasks; a copy of a row teaches nothing new
    texts = staged(texts.repartition(2 * max(2, docs.sparkSession.sparkContext.defaultParallelism), "key", "digest")
                   .dropDuplicates(["key", "digest"]), "toxic-texts")
    rows = windows(texts, None)
    if len(rows) > 3 * train_docs:   # ids with several texts
        kept = docs.sparkSession.createDataFrame([r[:2] for r in rows[:3 * train_docs]], "key string, digest string")
        texts = staged(texts.join(F.broadcast(kept), ["key", "digest"], "left_semi"), "toxic-texts")
        rows = rows[:3 * train_docs]

    def look(net):
        return [(own[0], z) for *_, z, own in windows(texts, Scorer(net, 1.0, 0.0, 0.0))]

    return fit([r[2] for r in rows], [r[4] for r in rows], look)


def windows(texts: DataFrame, scorer: Scorer | None) -> list[tuple]:
    """(key, digest, label, logit, windows) of each text with words, in order: its
    worst window, or without a scorer the first and the last one."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(scorer)   # about 1 MB of weights

    def run(batches):
        import pyarrow as pa
        scorer = shared.value
        for batch in batches:
            for at, group in slices(batch.column("text")):
                tokens = [words(t) for t in group]
                full = [i for i, own in enumerate(tokens) if own]
                if scorer:
                    found = [(z, [w]) for w, z in scorer.worst_windows(tokens)]
                else:
                    found = [(0.0, [tokens[i][:WINDOW], tokens[i][-WINDOW:]]) for i in full]
                kept = [c.slice(at, len(group)).take(pa.array(full, pa.int64())) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([f[0] for f in found], pa.float64()),
                     pa.array([f[1] for f in found], pa.list_(pa.list_(pa.string())))],
                    ["key", "digest", "label", "logit", "windows"])

    rows = texts.select("key", "digest", "label", "text").mapInArrow(
        run, "key string, digest string, label int, logit double, windows array<array<string>>").collect()
    shared.unpersist()
    return sorted(((r.key, r.digest, r.label, r.logit, r.windows) for r in rows), key=lambda r: r[:2])


def slices(texts):
    """(start, texts) of consecutive parts of a column of about SLICE_CHARS characters."""
    at = 0
    while at < len(texts):
        group, held = [], 0
        while at + len(group) < len(texts) and held < SLICE_CHARS:
            group.append(texts[at + len(group)].as_py())
            held += len(group[-1] or "")
        yield at, group
        at += len(group)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)   # about 1 MB of weights

    def run(batches):
        import pyarrow as pa
        scorer = shared.value
        for batch in batches:
            for at, group in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(scorer.scores(group), pa.float64())],
                    ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

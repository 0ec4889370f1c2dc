"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal)
under an elastic net, then calibrated with one temperature.

Features are hashed character 1- to 4-grams of the lower-cased text with runs
of non-letters as one blank. Document frequencies are counted over *all*
training documents (distributed; one bounded histogram per task). The
classifier itself is fitted on a bounded sample of labelled documents, of every
language the ``train_docs`` / languages with the smallest seeded hash (at least
``LEAST``; a language with fewer has all it has), of which every fifth only sets
the temperature. So a language is learned however rare it is. The L1 part of the penalty keeps most weights at exactly zero.

Prediction hashes whole texts in Arrow batches; a model is ``buckets`` x
languages numbers, whatever the corpus size. ``lang``, ``source`` and
``doc_id`` are never inputs of a prediction.

Defined cases: null text or text without a letter: ``und`` with score 0;
null lang or null doc_id: never learned from (a null id is not held out); if
nothing can be learned, every text is ``und``; ties go to the language that
sorts first; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import DOC_COLUMNS, seeded_key, ship, staged, table

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
TRAIN_DOCS = 2_000
#: documents of a language, however many languages share train_docs
LEAST = 100
UNKNOWN = "und"
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5e-3, 1e-5
#: the pipeline drops what is und or less sure than this
MIN_SCORE = 0.3

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_LATIN = re.compile(r"[A-Za-z]")
#: code points below 0x500: letters in lower case (where that is one character), all else a blank
_FOLD = np.array([ord(low) if chr(i).isalpha() and len(low := chr(i).lower()) == 1 else 0x20
                  for i in range(0x500)], np.uint32)


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def folded(text: str) -> np.ndarray:
    """Code points in lower case, with every run of non-letters as one blank."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < len(_FOLD), _FOLD[np.minimum(c, len(_FOLD) - 1)], c)
    blank = c == 0x20
    blank[1:] &= blank[:-1]
    blank[0] = False
    return c[~blank]


def grams(text: str) -> np.ndarray:
    """The hashed n-grams of a text, with repetitions."""
    c = folded(text)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in GRAMS:
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] * np.uint32(31)) ^ (c[n - 1:] * _MULT[n - 1])
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.int32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    n = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm > 0 else v).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray            # [buckets]
    weights: np.ndarray        # [buckets, langs]
    bias: np.ndarray           # [langs]
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        at, n = counts(text)
        z = (tfidf(at, n, self.idf) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.langs[best], float(p[best] / p.sum())


def ftrl(rows, n_classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l2: float = L2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (buckets, values, class) rows; weights and bias.

    Per coordinate it keeps the sum of squared gradients and a lazily
    regularised linear term; weights are derived from them when touched.
    """
    z = np.zeros((BUCKETS + 1, n_classes), np.float64)   # the last row is the bias
    s = np.zeros((BUCKETS + 1, n_classes), np.float64)
    rows = [(np.append(at, BUCKETS), np.append(v, np.float32(1.0)), y) for at, v, y in rows]
    order = np.random.default_rng(seed)

    def weights(at):
        zz, root = z[at], np.sqrt(s[at])
        w = -(zz - np.sign(zz) * l1) / ((beta + root) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w), root

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v, y = rows[i]
            w, root = weights(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            s[at] += g * g
            z[at] += g - (np.sqrt(s[at]) - root) / alpha * w
    w, _ = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS].astype(np.float32), w[BUCKETS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section on its logarithm."""
    if len(y) == 0:
        return 1.0

    def loss(log_t):
        u = logits / np.exp(log_t)
        u = u - u.max(1, keepdims=True)
        return float((np.log(np.exp(u).sum(1)) - u[np.arange(len(y)), y]).mean()) + 1e-3 * log_t * log_t

    a, b, r = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _idf(train: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all training documents."""
    def count(batches):
        import pyarrow as pa
        df, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    seen = np.zeros(BUCKETS, bool)
                    seen[grams(text)] = True
                    df += seen
                    docs += 1
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.arange(BUCKETS), -1).astype(np.int32)),
                 pa.array(np.append(df, docs))], ["bucket", "n"])

    total = train.select("text").mapInArrow(count, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS + 1)
    n[total["bucket"].to_numpy()] = total["n"].to_numpy()   # the number of documents is at -1
    return (np.log((1.0 + n[-1]) / (1.0 + n[:-1])) + 1.0).astype(np.float32)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on documents with text, lang and id whose id is not held out."""
    ship(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id")))
    idf = _idf(usable)
    key = seeded_key(F.col("doc_id"), "langid")
    letters = usable.filter(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))   # the others hold no letter
    total = {r["lang"]: r["count"] for r in letters.groupBy("lang").count().collect()}   # one row per language
    if not total:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    each = max(LEAST, -(-train_docs // len(total)))
    # about twice as many rows as needed pass their language's hash threshold and are ordered
    tops = [(lang, f"{int(2 * each / n * 2 ** 32):08x}" if n > 4 * each else "g") for lang, n in total.items()]
    tops = F.broadcast(docs.sparkSession.createDataFrame(tops, "lang string, top string"))
    sample = letters.select("lang", key.alias("key"), F.length("text").alias("size")) \
        .join(tops, "lang").filter("key < top").drop("top") \
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key", "size"))) \
        .filter(F.col("nth") <= each).drop("nth")
    sample = staged(sample, "langid-sample")

    def features(batches):
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if not has_letter(text):
                    continue
                at, n = counts(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()]), pa.array([batch.column(1)[i].as_py()]),
                     pa.array([at.tobytes()], pa.binary()),
                     pa.array([tfidf(at, n, idf).tobytes()], pa.binary())], ["key", "lang", "at", "v"])

    chosen = F.broadcast(sample.select("key", "lang", "size").distinct())   # ``each`` short rows a language
    rows = letters.withColumn("key", key).withColumn("size", F.length("text")) \
        .join(chosen, ["key", "lang", "size"], "left_semi").select("key", "lang", "text") \
        .mapInArrow(features, "key string, lang string, at binary, v binary") \
        .toPandas()
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rows = rows.sort_values(["key", "lang"], kind="stable").groupby("lang").head(each)
    nth = rows.groupby("lang").cumcount()
    data = [(np.frombuffer(at, np.int32), np.frombuffer(v, np.float32), langs.index(lang))
            for at, v, lang in zip(rows["at"], rows["v"], rows["lang"])]
    # every fifth of each language; of a language with fewer than five all are learned from
    fit, tune = [r for i, r in zip(nth, data) if i % 5 != 4], [r for i, r in zip(nth, data) if i % 5 == 4]
    w, bias = ftrl(fit, len(langs))
    logits = np.array([v @ w[at] + bias for at, v, _ in tune])
    return Model(langs, idf, w, bias, fit_temperature(logits, np.array([y for *_, y in tune])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the input's other document columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # buckets x languages, of fixed size

    def run(batches):
        import pyarrow as pa
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    out = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", lang_pred string, score double"
    return docs.mapInArrow(run, out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is known go on."""
    docs = docs.select(DOC_COLUMNS)
    model = train(docs)
    return predict(docs, model) \
        .filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(DOC_COLUMNS)

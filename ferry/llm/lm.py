"""Language-model scoring of whole documents: corpus counts and a recurrent model.

Counts: every training token is counted. Tasks count blocks of texts, one packed
row per block and route goes to the route of a word's hash, where the counts are
added up, so what is gathered grows with the corpus and no word is hot anywhere.

Model: ``gru_lm.GruLM``, over the 4,096 most frequent training words and 32 classes of
all others (by their last letters), ends included. A word outside the short list has
the chance of its class times (c + 1) / (N_k + V_k + 1) inside it, with the
class's own totals, so the chances of all words (and one unknown word per class) add
up to one. Short list, class totals and first biases come from the counts of all training
documents, and the weights learn from all of them: every one is dealt to a shard by its
hash, each shard's network goes once over all its texts, all from the same start, and the
weights are averaged by the tokens they saw. So the result does not depend on how the
table is partitioned. The start is a first fit on a bounded sample (below).

Every document is cut into words once more, whole, when its words have symbols: these are
written to the shared scratch folder, and the network learns and scores from there. Scoring
runs over all of a document, the network's
state going from window to window. The counts of the at most 131,072 most frequent
words are broadcast (words above 64 bytes by their SHA-256, so at most about 9 MB);
rarer words are looked up by a join with the table of counts, and only sums come back.

Sample of the start: the documents with the smallest seeded hash, at most ``TRAIN_DOCS``, together at
most ``TRAIN_BYTES`` of text; documents above a quarter of that are left out of it.

Defined cases: null text is empty (only its end is scored); rows without doc_id are
not held out; repeated rows count each time and each get a row; without training
documents all counts are 0 and the model is uniform over its classes.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import seeded_key, ship, single_thread_blas, smallest, staged, table
from ferry.llm.gru_lm import GruLM

SHORT_LIST, TAILS = 4096, 32
HOT_WORDS = 1 << 17
LONG_WORD = 64
TRAIN_DOCS, TRAIN_BYTES = 2000, 4 << 20
SHARD_TOKENS = 1 << 20     # about as many training tokens a network of the pass over all texts sees
STREAMS = 256              # rows of texts it learns from at once
CHUNKS = 64                # parts its weights are added up in
BLOCK_WORDS = 1 << 20      # words counted at once in a task
SCORE_WORDS = 1 << 21      # words scored at once in a task, so that long texts run beside many others
SCORE_TEXTS = 1 << 16      # texts scored at once
SLICE_BYTES = 2 << 20      # whole texts cut into words at once
CACHE_WORDS = 1 << 18      # words a task remembers


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def cut_words(texts):
    """``words`` of an Arrow array of texts, in slices of whole texts with about SLICE_BYTES:
    (first row, distinct words, each word's place among them, words of every text)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts[a:b]))
        flat, n = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0)        # white space at an end gives an empty word
        if len(flat):
            upto = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
            ends = np.cumsum(n)
            n = upto[ends] - upto[ends - n]
        flat = flat.filter(full).cast(pa.large_binary()).dictionary_encode()
        _, ends, data = flat.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(flat.dictionary) + 1].tolist() if ends else [0]
        data = data.to_pybytes() if data else b""
        yield a, [data[i:j] for i, j in zip(ends, ends[1:])], flat.indices.to_numpy(zero_copy_only=False), n


def key_of(word: bytes) -> bytes:
    """The word itself, or of a long one a mark that no text holds and its digest."""
    return word if len(word) <= LONG_WORD else b"\xff" + sha256(word).hexdigest().encode()


def tail_of(key: bytes) -> int:
    """The class of a word outside the short list: long words, or by the last two bytes."""
    if key[0] == 0xff:
        return TAILS - 1
    return (key[-1] * 31 + key[-2:-1][0] if len(key) > 1 else key[-1]) % (TAILS - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


# -- counts ------------------------------------------------------------------------

class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.words = []

    def __missing__(self, word):
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


def word_counts(texts: DataFrame) -> DataFrame:
    """key, c, tail of every distinct word of the column text."""
    ship(texts.sparkSession)
    routes = 16 * max(1, texts.rdd.getNumPartitions())

    def count(batches):
        import pyarrow as pa
        numbers, counted, held = _Numbers(), [], 0

        def emit():
            at, n = (np.concatenate(c) for c in zip(*counted))
            total = np.bincount(at, n, len(numbers.words)).astype(np.int64)
            keys = [key_of(w) for w in numbers.words]
            route = np.fromiter((xxhash.xxh64_intdigest(k) % routes for k in keys), np.int64, len(keys))
            order = np.argsort(route, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(route[order]) > 0))
            rows = [(int(route[part[0]]), b"\n".join([keys[i] for i in part]), total[part].tobytes())
                    for part in np.split(order, cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                ["route", "words", "counts"])

        for batch in batches:
            for _, own, at, _ in cut_words(batch.column(0)):
                if own:
                    counted.append((np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)), np.bincount(at)))
                    held += len(at)
                if held >= BLOCK_WORDS:
                    yield emit()
                    numbers, counted, held = _Numbers(), [], 0
        if held:
            yield emit()

    def add(group):
        import pyarrow as pa
        numbers, at, n = _Numbers(), [], []
        for keys, counts in zip(group.column("words").to_pylist(), group.column("counts").to_pylist()):
            own = keys.split(b"\n")
            at.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
            n.append(np.frombuffer(counts, np.int64))
        at, n = np.concatenate(at), np.concatenate(n)
        total = np.zeros(len(numbers.words), np.int64)
        np.add.at(total, at, n)
        return pa.table({"key": pa.array(numbers.words, pa.binary()), "c": total,
                         "tail": pa.array([tail_of(k) for k in numbers.words], pa.int32())})

    width = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), routes // 4)
    packed = texts.select("text").mapInArrow(count, "route long, words binary, counts binary")
    return packed.repartition(width, "route").groupBy("route").applyInArrow(add, "key binary, c long, tail int")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The words of ``counts`` above the lowest count that at most ``limit`` words reach.

    Found from a small histogram of the counts (16 steps per doubling)."""
    step = F.floor(F.log2(F.col("c")) * 16)
    steps = counts.groupBy(step.alias("step")).count().collect()      # some hundred rows
    least, held = math.inf, 0
    for r in sorted(steps, key=lambda r: -r.step):
        held += r["count"]
        if held > limit:
            break
        least = r.step
    return counts.filter(step >= (least if steps and least < math.inf else 1 << 30))


# -- model ---------------------------------------------------------------------------

@dataclass
class Scorer:
    """What a scoring task needs; about 10 MB."""
    lm: GruLM
    hot: dict           # key -> (short-list number or -1, occurrences)
    tails: np.ndarray   # per class of other words: N_k + V_k + 1
    ends: int           # training documents
    tokens: int         # N
    distinct: int       # V

    def symbol(self, key: bytes) -> tuple[int, int]:
        """(symbol of the network, occurrences or -1 if they must be looked up)."""
        at, c = self.hot.get(key, (-1, -1))
        return (at if at >= 0 else self.lm.words + tail_of(key)), c


def begin(docs: DataFrame, counts: DataFrame, n_docs: int, train_docs: int = TRAIN_DOCS,
          train_bytes: int = TRAIN_BYTES) -> Scorer:
    """``docs``: the training documents, ``counts``: their words' counts (staged)."""
    single_thread_blas()
    hot = sorted(((bytes(r.key), r.c) for r in most_frequent(counts, HOT_WORDS).select("key", "c").collect()),
                 key=lambda r: (-r[1], r[0]))
    short = min(SHORT_LIST, len(hot))
    totals, distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        totals[r.tail], distinct[r.tail] = r.c, r.n
    tokens, types = int(totals.sum()) + n_docs, int(distinct.sum()) + (n_docs > 0)
    for key, c in hot[:short]:
        totals[tail_of(key)] -= c
        distinct[tail_of(key)] -= 1
    lm = GruLM(short, TAILS, np.array([c for _, c in hot[:short]] + totals.tolist() + [n_docs], np.float64))
    scorer = Scorer(lm, {k: (i if i < short else -1, c) for i, (k, c) in enumerate(hot)},
                    (totals + distinct + 1).astype(np.float64), n_docs, tokens, types)
    size = F.octet_length("text")
    some = docs.select("text", seeded_key(F.col("doc_id"), "lm").alias("key"), F.md5("text").alias("digest")) \
        .filter(size.between(1, train_bytes // 4))
    upto = Window.orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, 0)      # at most train_docs rows
    some = smallest(some, train_docs, "key", "digest").withColumn("upto", F.sum(size).over(upto)) \
        .filter(F.col("upto") <= train_bytes).orderBy("key", "digest").select("text").collect()
    texts = [np.array([scorer.symbol(key_of(w))[0] for w in words(r.text)], np.int64) for r in some]
    texts = [t for t in texts if len(t)]
    if texts:
        lm.fit(texts)
    return scorer


def train(docs: DataFrame, counts: DataFrame, n_docs: int, train_docs: int = TRAIN_DOCS,
          train_bytes: int = TRAIN_BYTES, shard_tokens: int = SHARD_TOKENS) -> Scorer:
    """The whole model of the training documents ``docs``; see ``begin``."""
    scorer = begin(docs, counts, n_docs, train_docs, train_bytes)
    if n_docs:
        learn_all(encode(docs, scorer), scorer, shard_tokens)
    return scorer


class _Seen(_Numbers):
    """Numbers of words, with what the scorer knows of each."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer, self.symbol, self.count = scorer, array("H"), array("q")

    def look_up(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, occurrences or -1) by number."""
        for w in self.words[len(self.symbol):]:
            at, c = self.scorer.symbol(key_of(w))
            self.symbol.append(at)
            self.count.append(c)
        return np.array(self.symbol, np.uint16), np.array(self.count, np.int64)


def encode(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Every document cut into words once, for the network's learning and for the scores: its
    symbols (two bytes each) and the sums over words that need no network, and a row for each
    of its words whose count must be looked up."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa
        scorer = shared.value
        log_ends, inside = math.log10(scorer.ends + 1), np.log10(scorer.tails)
        seen = _Seen(scorer)
        for batch in batches:
            for start, own, at, n in cut_words(batch.column(4)):
                if len(seen) > CACHE_WORDS:
                    seen = _Seen(scorer)
                number = np.fromiter(map(seen.__getitem__, own), np.int64, len(own))
                symbols, counted = (x[number] for x in seen.look_up())
                logs = np.log10(np.maximum(counted, 0) + 1.0)
                tail = symbols.astype(np.int64) - scorer.lm.words
                other = np.where(tail >= 0, logs - inside[np.maximum(tail, 0)], 0.0)
                text = np.repeat(np.arange(len(n)), n)
                add = lambda x: np.bincount(text, x[at], len(n))  # noqa: E731, B023
                known = add(counted > 0).astype(np.int64) + (scorer.ends > 0)
                ids = [batch.column(i)[start:start + len(n)] for i in range(4)]
                ends = np.append(0, 2 * np.cumsum(n)).astype(np.int32)
                flat = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(symbols[at])])
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(n + 1, pa.int64()), pa.array(known), pa.array(add(logs) + log_ends, pa.float64()),
                     pa.array(add(other), pa.float64()), flat, pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.int64())], ENCODED)
                asked = counted[at] < 0
                if asked.any():
                    pairs, times = np.unique(text[asked] * len(own) + at[asked], return_counts=True)
                    rare = [key_of(w) for w, c in zip(own, counted.tolist()) if c < 0]
                    place = np.cumsum(counted < 0) - 1
                    words = pa.array(rare, pa.binary()).take(pa.array(place[pairs % len(own)]))
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [ids[0].take(pa.array(pairs // len(own))), *(pa.nulls(len(pairs), t) for t in kinds), words,
                         pa.array(times.astype(np.int64))], ENCODED)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"),
                           (~held_out(F.col("doc_id"))).alias("learns"), F.xxhash64(doc_id, text).alias("hash"),
                           text.alias("text"))
    return staged(numbered.mapInArrow(run, "row long, doc_id long, learns boolean, hash long, n_tokens long, "
                                           "n_known long, base double, other double, symbols binary, word binary, "
                                           "times long"), "lm-parts")


ENCODED = ["row", "doc_id", "learns", "hash", "n_tokens", "n_known", "base", "other", "symbols", "word", "times"]


def learn_all(encoded: DataFrame, scorer: Scorer, shard_tokens: int = SHARD_TOKENS) -> None:
    """The network of ``scorer`` goes once over all training documents, in shards side by side.

    A task holds one shard's symbols (two bytes each) and the weights; of all tasks, only
    sums of weights meet, in ``CHUNKS`` parts."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scorer.lm)
    shards = max(1, -(-scorer.tokens // shard_tokens))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 4)

    def fit(batches):
        import pyarrow as pa
        single_thread_blas()
        start = shared.value
        total, seen, held, tokens, at = 0.0, 0, [], 0, None

        def learned():
            own = start.copy().fit(held, epochs=1, streams=STREAMS)
            return tokens * own.weights().astype(np.float64)

        for batch in batches:
            for shard, symbols in zip(batch.column(0).to_pylist(), batch.column(1)):
                # copies all have one hash: what is held stays bounded
                if held and (shard != at or tokens >= 2 * shard_tokens):
                    total, seen, held, tokens = total + learned(), seen + tokens, [], 0
                at = shard
                held.append(np.frombuffer(symbols.as_py(), np.uint16))
                tokens += len(held[-1]) + 1
        if held:
            total, seen = total + learned(), seen + tokens
            parts = [p.tobytes() for p in np.array_split(total, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([seen] * CHUNKS, pa.int64()),
                                              pa.array(parts, pa.binary())], ["chunk", "seen", "total"])

    def add(group):
        import pyarrow as pa
        total = sum(np.frombuffer(p.as_py()) for p in group.column("total"))
        return pa.table({"chunk": group.column("chunk")[:1], "seen": [sum(group.column("seen").to_pylist())],
                         "total": pa.array([total.tobytes()], pa.binary())})

    sums = encoded.filter("word IS NULL AND learns") \
        .select(F.pmod("hash", F.lit(shards)).alias("shard"), F.col("hash").alias("key"), "symbols") \
        .repartition(width, "shard").sortWithinPartitions("shard", "key").select("shard", "symbols") \
        .mapInArrow(fit, "chunk int, seen long, total binary") \
        .groupBy("chunk").applyInArrow(add, "chunk int, seen long, total binary").collect()     # about 1 MB
    sums = sorted(sums, key=lambda r: r.chunk)
    scorer.lm.set_weights(np.concatenate([np.frombuffer(r.total) for r in sums]) / sums[0].seen)


def score(encoded: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(scorer.lm)

    def run(batches):
        import pyarrow as pa
        single_thread_blas()
        lm, own, held, kept = shared.value, [], 0, []

        def emit():
            found = lm.log_likelihood(own) / math.log(10)
            rows = pa.Table.from_batches(kept).combine_chunks()
            whole = pa.array(rows.column("other").to_numpy() + found)
            return pa.table([*(rows.column(c) for c in ("row", "doc_id", "n_tokens", "n_known", "base")), whole],
                            ["row", "doc_id", "n_tokens", "n_known", "base", "whole"]).to_batches()

        for batch in batches:
            done = 0
            flat = batch.column(6)
            ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] // 2
            symbols = np.frombuffer(flat.buffers()[2] or b"", np.uint16)
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                own.append(symbols[a:b])
                held += b - a + 1
                if held >= SCORE_WORDS or len(own) >= SCORE_TEXTS:
                    kept.append(batch.slice(done, i + 1 - done).select(list(range(6))))
                    yield from emit()
                    own, held, kept, done = [], 0, [], i + 1
            if done < len(batch):
                kept.append(batch.slice(done).select(list(range(6))))
        if own:
            yield from emit()

    # (expensive, so written once)
    scored = staged(encoded.filter("word IS NULL")
                    .select("row", "doc_id", "n_tokens", "n_known", "base", "other", "symbols")
                    .mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, whole double"),
                    "lm-scores")
    # rare words: their counts, and of each document only the sums
    rare = encoded.filter("word IS NOT NULL").select("row", F.col("word").alias("key"), "times").join(counts, "key") \
        .groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(scorer.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(scorer.tokens + scorer.distinct + 1)))
        .alias("base_score"), (F.col("whole") + more).alias("score"))


def language_model_scores(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, **bounds) -> DataFrame:
    """Counts, model and scores of ``docs`` (doc_id, text); see ``train`` for the bounds."""
    learn = docs.filter(~held_out(F.col("doc_id")))
    counts, n_docs = staged(word_counts(learn), "lm-counts"), learn.count()
    scorer = begin(learn, counts, n_docs, **bounds)
    encoded = encode(docs, scorer)
    if n_docs:
        learn_all(encoded, scorer, shard_tokens)
    return score(encoded, scorer, counts)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))

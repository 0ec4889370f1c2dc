"""Phrase collocations: multikey three-way quicksort of suffix pointers.

Every word position of a text is a suffix pointer. The pointers of a block of
texts are put into equal partitions by a three-way quicksort on their first,
then second, then third word (``equal_partitions``); the size of an equal
partition is the phrase's count in the block. One packed row per block and
route then goes to the route of the phrase's leading words, where the blocks'
partitions are merged by the same sort, with their sizes as weights. Counts are
then global, so a partition below the limit is abandoned: no longer phrase is
looked for behind it.

The depth grows by one word per level, and level d + 1 sorts only pointers whose
two phrases of d words both survived. Survivors are told by a bit per hash (at
most 32 MB, broadcast); a hash shared with a survivor lets a phrase through to
be counted, which the exact count behind the route then settles. A route takes a
phrase's d words, and a block sends a phrase once, so no phrase, however
frequent, sends more rows to one task than there are blocks.

Defined cases: null text has no words, null ``lang`` is ``und``; words may hold any
other characters; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import ship, staged, table

LEAST = 10            # occurrences of a candidate
COVERED = 50          # percent of a phrase's occurrences inside a longer candidate that drop it
TOP = 2000            # phrases reported per language
BLOCK_WORDS = 1 << 21  # words sorted at once in a task
ROUTE_WORDS = 1 << 19  # words of the corpus per route
SMALL = 32            # partitions up to this many pointers are finished together
BITS = (1 << 20, 1 << 28)   # least and largest size of the survivors' bitmap

# piece ends become the word ".", which no piece can hold
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def equal_partitions(keys: np.ndarray, weight: np.ndarray | None = None, least: int = 1):
    """(first pointer, weight) of every set of pointers with equal words.

    ``keys[d, i]``: the d-th word of pointer i. Partitions are split breadth
    first around the median of three; those lighter than ``least`` are abandoned
    at whatever depth they are found.
    """
    depth, n = keys.shape
    pointers = np.arange(n, dtype=np.int64)
    lengths, at = np.array([n], np.int64), np.zeros(1, np.int64)
    heads, sizes, rest = [], [], []
    flat = keys.ravel()
    while True:
        starts = np.cumsum(lengths) - lengths
        size = lengths if weight is None or not n else np.add.reduceat(weight[pointers], starts) if len(lengths) else lengths
        done, small = at == depth, lengths <= SMALL
        light = size < least
        heads.append(pointers[starts[done & ~light]])
        sizes.append(size[done & ~light])
        finish = small & ~done & ~light
        rest.append(pointers[np.repeat(finish, lengths)])
        live = ~(done | small | light)
        if not live.any():
            break
        pointers = pointers[np.repeat(live, lengths)]
        lengths, at = lengths[live], at[live]
        starts = np.cumsum(lengths) - lengths
        words = flat[pointers + np.repeat(at * n, lengths)]
        a, b, c = words[starts], words[starts + lengths // 2], words[starts + lengths - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), lengths)
        less, same = words < pivot, words == pivot
        n_less, n_same = (np.add.reduceat(x, starts, dtype=np.int64) for x in (less, same))
        pointers = np.concatenate([pointers[less], pointers[same], pointers[~(less | same)]])
        lengths = np.concatenate([n_less, n_same, lengths - n_less - n_same])
        at = np.concatenate([at, at + 1, at])
        at, lengths = at[lengths > 0], lengths[lengths > 0]
    # what is left of small partitions: sorted by all words, cut where a word changes
    last = np.concatenate(rest)
    if len(last):
        last = last[np.lexsort(keys[::-1, last])]
        own = keys[:, last]
        starts = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(0)))
        size = np.diff(np.append(starts, len(last))) if weight is None else np.add.reduceat(weight[last], starts)
        heads.append(last[starts[size >= least]])
        sizes.append(size[size >= least])
    return np.concatenate(heads), np.concatenate(sizes)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hash(lang: str, hashes: np.ndarray) -> np.ndarray:
    """One hash per column of ``hashes[d, i]``, the hashes of the words of phrase i."""
    h = np.full(hashes.shape[1], word_hash(lang.encode()), np.uint64)
    for row in hashes:
        h = (h ^ row) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


class _Vocabulary(dict):
    """Word -> number in order of appearance; piece ends are -1."""

    def __init__(self):
        super().__init__({b".": -1})
        self.words = []

    def __missing__(self, word):
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self.words), np.uint64, len(self.words))


class Alive:
    """A bit per hash of the survivors of one level."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(level: DataFrame, count: int) -> "Alive":
        size = BITS[0]
        while size < min(16 * count, BITS[1]):
            size *= 2
        slot = level.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("slot"))
        rows = slot.groupBy(F.shiftright("slot", 15).alias("page")) \
            .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")).collect()
        bits = np.zeros(size >> 3, np.uint8)     # at most BITS[1] / 8 bytes
        for r in rows:
            bits[r.page << 12:(r.page + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
        return Alive(bits)


def _tokens(text: str) -> list[bytes]:
    """Words in order, with "." at every piece end and after the text."""
    return text.encode().lower().translate(_ENDS).replace(b".", b" . ").split() + [b"."]


class _Block:
    """The words of some texts of one language."""

    def __init__(self, lang: str):
        self.lang, self.vocabulary, self.numbers, self.held = lang, _Vocabulary(), [], 0

    def add(self, text: str) -> None:
        words = _tokens(text)
        get = self.vocabulary.__getitem__
        self.numbers.append(np.fromiter(map(get, words), np.int32, len(words)))
        self.held += len(words)

    def phrases(self, depth: int, hashes: np.ndarray, words_alive, shorter_alive):
        """(words[d, i] as numbers, count[i]) of the phrases of this block."""
        ids = np.concatenate(self.numbers)
        if words_alive is not None:
            alive = words_alive.holds(phrase_hash(self.lang, hashes[None]))
            ids = np.where(np.append(alive, False)[ids], ids, -1)
        n = len(ids) - depth + 1
        if n <= 0:
            return np.zeros((depth, 0), np.int32), np.zeros(0, np.int64)
        ok = ids[:n] >= 0
        for d in range(1, depth):
            ok &= ids[d:n + d] >= 0
        at = np.flatnonzero(ok)
        if depth == 1:      # the vocabulary already is the partition by leading word
            counts = np.bincount(ids[at], minlength=len(self.vocabulary.words))
            return np.arange(len(counts), dtype=np.int32)[None], counts
        if depth > 2:
            for d in range(2):
                shorter = np.stack([hashes[ids[at + d + j]] for j in range(depth - 1)])
                at = at[shorter_alive.holds(phrase_hash(self.lang, shorter))]
        keys = np.stack([ids[at + d] for d in range(depth)])
        heads, counts = equal_partitions(keys)
        return keys[:, heads], counts

    def packed(self, depth: int, routes: int, words_alive, shorter_alive):
        """One (route, lang, words, (numbers, counts)) per route that gets a phrase."""
        hashes = self.vocabulary.hashes()
        keys, counts = self.phrases(depth, hashes, words_alive, shorter_alive)
        route = (phrase_hash(self.lang, hashes[keys]) >> np.uint64(8)) % np.uint64(routes)
        order = np.argsort(route, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(route[order]) > 0)) if len(order) else []
        for start, end in zip(cuts, [*cuts[1:], len(order)]):
            part = order[start:end]
            used, numbers = np.unique(keys[:, part], return_inverse=True)
            cells = (numbers.reshape(depth, -1), counts[part])
            yield (int(route[part[0]]), self.lang, b"\n".join([self.vocabulary.words[i] for i in used]),
                   pickle.dumps([x.astype(np.min_scalar_type(x.max())) for x in cells], protocol=5))


PACKED = "route long, lang string, words binary, cells binary"


def _level(docs: DataFrame, depth: int, routes: int, least: int, words_alive=None, shorter_alive=None) -> DataFrame:
    """lang, w1..w``depth``, n, h of the phrases that occur at least ``least`` times; at
    depth 1 also a row per language and route without a word: n, all its words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words_alive, shorter_alive))   # at most 64 MB

    def sort_blocks(batches):
        import pyarrow as pa
        words_alive, shorter_alive = shared.value
        blocks: dict[str, _Block] = {}

        def emit(langs):
            for lang in langs:
                rows = list(blocks.pop(lang).packed(depth, routes, words_alive, shorter_alive))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                        ["route", "lang", "words", "cells"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text:
                    lang = lang.as_py()
                    if lang not in blocks:
                        blocks[lang] = _Block(lang)
                    blocks[lang].add(text)
                    if sum(b.held for b in blocks.values()) >= BLOCK_WORDS:
                        yield from emit(list(blocks))
        yield from emit(list(blocks))

    names = [f"w{d + 1}" for d in range(depth)]

    def merge(group):
        import pyarrow as pa
        by_lang: dict[str, list] = {}
        for lang, *packed in zip(*(group.column(c) for c in ("lang", "words", "cells"))):
            by_lang.setdefault(lang.as_py(), []).append([x.as_py() for x in packed])
        out = {c: [] for c in ("lang", *names, "n", "h")}
        for lang, parts in by_lang.items():
            vocabulary = _Vocabulary()
            keys, counts = [], []
            for words, cells in parts:
                own = np.fromiter(map(vocabulary.__getitem__, words.split(b"\n")), np.int32)
                numbers, n = pickle.loads(cells)
                keys.append(own[numbers])
                counts.append(n.astype(np.int64))
            keys, counts = np.concatenate(keys, 1), np.concatenate(counts)
            heads, sizes = equal_partitions(keys, counts, least)
            found = keys[:, heads]
            hashes = phrase_hash(lang, vocabulary.hashes()[found]).view(np.int64)
            rows = [*([vocabulary.words[i].decode() for i in row] for row in found), sizes.tolist(), hashes.tolist()]
            if depth == 1:
                rows = [[*rows[0], None], [*rows[1], int(counts.sum())], [*rows[2], 0]]
            for c, own in zip((*names, "n", "h"), rows):
                out[c] += own
            out["lang"] += [lang] * len(rows[0])
        return pa.table({c: pa.array(v, pa.int64() if c in "nh" else pa.string()) for c, v in out.items()})

    # the width follows the routes, and so the corpus
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-routes // 4))
    packed = docs.mapInArrow(sort_blocks, PACKED).repartition(width, "route")
    schema = ", ".join(["lang string", *(f"{c} string" for c in names), "n long", "h long"])
    return staged(packed.groupBy("route").applyInArrow(merge, schema), f"phrases-{depth}")


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 a a / (left right)) in 38-digit integers; never above 1000000."""
    whole = lambda c, digits: f"CAST({c} AS DECIMAL({digits}, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole(a, 15)} * {whole(a, 15)}) "
                  f"div ({whole(left, 19)} * {whole(right, 19)})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to 3 words of each language.

    ``docs`` needs the columns text and lang. Ties are ordered by count, then phrase.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.col("text").cast("string").alias("text"))
    splits = max(1, texts.rdd.getNumPartitions())
    first = _level(texts, 1, 16 * splits, least)
    total = first.filter("w1 IS NULL").groupBy(F.col("lang").alias("of")).agg(F.sum("n").cast("long").alias("total"))
    one = first.filter("w1 IS NOT NULL")
    sums = first.agg(F.sum(F.when(F.col("w1").isNull(), F.col("n"))).alias("words"), F.count("w1").alias("kept")).first()
    routes = max(1, (sums.words or 0) // ROUTE_WORDS)
    words_alive = Alive.of(one, sums.kept)
    two = _level(texts, 2, routes, least, words_alive)
    three = _level(texts, 3, routes, least, words_alive, Alive.of(two, two.count()))

    def count_of(level: DataFrame, words: list[str], name: str) -> DataFrame:
        """The counts of ``level`` keyed for a join on these words of a phrase."""
        own = [c for c in level.columns if c[0] == "w"]
        return level.select("lang", *(F.col(c).alias(w) for c, w in zip(own, words)), F.col("n").alias(name))

    pairs = two.select("lang", "w1", "w2", F.col("n").alias("a")) \
        .join(count_of(one, ["w1"], "l"), ["lang", "w1"]).join(count_of(one, ["w2"], "r"), ["lang", "w2"])
    longer = three.select("lang", "w1", "w2", "n").unionByName(
        three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n")) \
        .groupBy("lang", "w1", "w2").agg(F.max("n").alias("inside"))
    pairs = pairs.join(longer, ["lang", "w1", "w2"], "left") \
        .filter(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * covered)) \
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    triples = three.select("lang", "w1", "w2", "w3", F.col("n").alias("a")) \
        .join(count_of(one, ["w1"], "l1"), ["lang", "w1"]).join(count_of(two, ["w2", "w3"], "r1"), ["lang", "w2", "w3"]) \
        .join(count_of(two, ["w1", "w2"], "l2"), ["lang", "w1", "w2"]).join(count_of(one, ["w3"], "r2"), ["lang", "w3"]) \
        .withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                             F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
                             F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(total, F.col("lang") == F.col("of")) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
p AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS words
      FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, words, count(*)::BIGINT AS n FROM p GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.words, c.k, c.n AS a, place.cut, l.n AS l, r.n AS r,
         ((1000000::HUGEINT * c.n * c.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM c, (VALUES (1), (2)) AS place(cut)
  JOIN f l ON l.lang = c.lang AND l.words = list_slice(c.words, 1, place.cut)
  JOIN f r ON r.lang = c.lang AND r.words = list_slice(c.words, place.cut + 1, c.k)
  WHERE place.cut < c.k),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inside AS (SELECT lang, words, max(n) AS n FROM (
             SELECT lang, words[1:2] AS words, n FROM c WHERE k = 3 UNION ALL
             SELECT lang, words[2:3] AS words, n FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, words)
         WHERE inside.n IS NULL OR 100 * inside.n < 50 * lowest.a),
ranked AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
JOIN total USING (lang) WHERE rank <= 2000
"""

"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form (ties: leftmost first). The best pair is merged, pairs
that a merge made stale are skipped when they surface, and the pairs around the
new symbol enter the agenda. A character outside the vocabulary becomes its
UTF-8 bytes' pieces.

Two neighbouring characters that occur side by side in no piece can never be
merged over, so a text is cut there first (vectorised over code points; pairs
of characters beyond the table are never cut) and the agenda runs once per
distinct segment (many short ones side by side in arrays): segments are kept in a
bounded per-worker cache. The cut changes no result, because merges on both sides of
it do not interact.

Every text is encoded whole. Every document is also encoded by the
sentencepiece library, and its ids decoded by it; any difference in ids or
text stops the job.

Only models with the identity normaliser, escaped white space, a dummy prefix
and byte fallback are accepted; the constructor refuses others.

Defined cases: null and empty texts give no ids and decode to the empty text;
null ids, repeated rows and extra columns are fine (only ``doc_id`` and
``text`` are read); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from array import array
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.common import ship, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: code points below this are cut by table; beyond it segments are only cut before a space
TABLE = 1024
#: words and segments a worker remembers (about 200 bytes each)
CACHE = 250_000
CACHE_LENGTH = 40
#: segments up to this length use the flat agenda, longer ones the heap
FLAT_LENGTH = 24
SLICE_CHARS = 1_000_000
#: one document in so many is compared with the library: all of them
CHECK_EVERY = 1
NEVER = float("inf")
NO_RANK = np.int32(2 ** 31 - 1)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces:
    """One vocabulary, loaded through the library; encoding and decoding are done here."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b c\u00b2 \u00e9 "
        if "".join(sp.encode(probe, out_type=str)).replace(SPACE, " ") != " " + probe:
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        n = sp.get_piece_size()
        self.normal = {}
        self.surface = [b""] * n
        self.byte = [0] * 256
        self.control = set()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif sp.is_unknown(i):
                self.unknown = i
                self.surface[i] = " ⁇ ".encode()
            elif sp.is_control(i):
                self.control.add(i)
            else:
                if sp.is_unused(i):
                    raise ValueError("unused pieces are not supported")
                self.normal[piece] = (-sp.get_score(i), i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.order = {piece: rank for piece, (rank, _) in self.normal.items()}
        self.id = {piece: i for piece, (_, i) in self.normal.items()}
        if not self.byte[0]:
            raise ValueError("the model must have byte fallback")
        # may[a, b]: the characters a and b stand side by side in some piece
        may = np.zeros((TABLE + 1, TABLE + 1), bool)
        for piece in self.normal:
            for a, b in zip(piece, piece[1:]):
                may[self._at(a), self._at(b)] = True
        self.cut_before_space = not any(b == SPACE and a != SPACE for p in self.normal for a, b in zip(p, p[1:]))
        may[TABLE, :] = True  # not in the table: keep together
        may[:, TABLE] = True
        if self.cut_before_space:
            may[TABLE, self._at(SPACE)] = False
        self.cuts = ~may
        self.leads = [sp.id_to_piece(i).startswith(SPACE) for i in range(n)]
        self._pair_tables()
        self.limit = CACHE
        self.cache: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}

    def _pair_tables(self) -> None:
        """What ``agendas`` needs as arrays: a number for every symbol (piece, or character of
        one), and for every two symbols that form a piece its rank and number."""
        symbols = [*self.normal, *({c for p in self.normal for c in p} - set(self.normal))]
        number = {s: i for i, s in enumerate(symbols)}
        ranks = {r: k for k, r in enumerate(sorted(set(self.order.values())))}
        pairs = {}
        for piece in self.normal:
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * (len(symbols) + 1) + b] = number[piece]
        # the last entry is found for what is beyond all others
        self.pairs = np.array([*sorted(pairs), 1 << 62], np.int64)
        self.formed = np.array([*(pairs[k] for k in sorted(pairs)), 0], np.int32)
        by_symbol = np.array([ranks[self.order[s]] if s in self.order else 0 for s in symbols], np.int32)
        self.formed_rank = by_symbol[self.formed]
        self.symbol_id = np.array([*(self.id.get(s, -1) for s in symbols), -1], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that two symbols form, ``NO_RANK`` where there is none."""
        key = left.astype(np.int64) * len(self.symbol_id) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.formed_rank[at], NO_RANK), self.formed[at]

    def agendas(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The same agenda for many segments side by side: in every round each takes its best
        pair (ties: leftmost); one whose agenda is empty leaves."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        text = "".join(segments).encode("utf-32-le", "surrogatepass")
        sym = self.symbol_of[np.frombuffer(text, np.uint32)]
        row = np.repeat(np.arange(len(segments)), sizes)
        last = np.ones(len(sym), bool)
        last[:-1] = row[1:] != row[:-1]
        rank, forms = self._ranks(sym, np.append(sym[1:], -1))
        rank[last] = NO_RANK
        done = []
        while len(sym):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            if (best == NO_RANK).any():
                over = np.repeat(best == NO_RANK, sizes)
                done.append((row[over], sym[over]))
                going = ~over
                sym, row, last, rank, forms = sym[going], row[going], last[going], rank[going], forms[going]
                sizes, best = sizes[best != NO_RANK], best[best != NO_RANK]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hits[np.append(True, row[hits[1:]] != row[hits[:-1]])]
            sym[at] = forms[at]
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, row, last, rank, forms = sym[stay], row[stay], last[stay], rank[stay], forms[stay]
            at = at - np.arange(len(at))        # one symbol went in every segment before
            before = at[at > 0] - 1
            new = np.append(at[~last[at]], before[~last[before]])
            rank[at] = NO_RANK
            rank[new], forms[new] = self._ranks(sym[new], sym[new + 1])
        row, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(row, kind="stable")
        ids, row = self.symbol_id[sym[order]], row[order]
        ends = np.cumsum(np.bincount(row, minlength=len(segments))).tolist()
        # a character without a piece becomes its bytes' pieces
        bare = set(row[ids < 0].tolist())
        flat = ids.tolist()
        return [self.flat_agenda(segments[i]) if i in bare else tuple(flat[a:b])
                for i, (a, b) in enumerate(zip([0, *ends], ends))]

    @staticmethod
    def _at(c: str) -> int:
        # the space symbol takes the row of code point 0x20, which no escaped text holds
        return 0x20 if c == SPACE else min(ord(c), TABLE)

    def segments(self, text: str) -> list[str]:
        """The escaped text cut where no piece can reach over."""
        s = SPACE + text.replace(" ", SPACE)
        at = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.where(at == 0x2581, 0x20, np.minimum(at, TABLE)).astype(np.int32)
        cuts = (np.flatnonzero(self.cuts[at[:-1], at[1:]]) + 1).tolist()
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])]

    def agenda(self, segment: str) -> tuple[int, ...]:
        """The ids of one segment."""
        normal = self.normal
        whole = normal.get(segment)
        sym: list[str | None] = list(segment)
        n = len(sym)
        if whole is not None and n == 1:
            return (whole[1],)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        todo = []
        for i in range(n - 1):
            hit = normal.get(sym[i] + sym[i + 1])
            if hit is not None:
                todo.append((hit[0], i, sym[i] + sym[i + 1], i + 1))
        heapq.heapify(todo)
        pop, push = heapq.heappop, heapq.heappush
        while todo:
            _, i, piece, j = pop(todo)
            left, right = sym[i], sym[j]
            # stale: one of the two was merged since
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(piece):
                continue
            sym[i] = piece
            sym[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = piece + sym[k]
                hit = normal.get(both)
                if hit is not None:
                    push(todo, (hit[0], i, both, k))
            h = before[i]
            if h >= 0:
                both = sym[h] + piece
                hit = normal.get(both)
                if hit is not None:
                    push(todo, (hit[0], h, both, i))
        out = []
        for piece in sym:
            if piece is not None:
                hit = normal.get(piece)
                if hit is not None:
                    out.append(hit[1])
                else:
                    out.extend(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
        return tuple(out)

    def flat_agenda(self, segment: str) -> tuple[int, ...]:
        """The same agenda for a short segment, as a flat list: finding the best
        pair is a scan, and no entry is ever stale."""
        get = self.order.get
        sym = list(segment)
        agenda = [get(pair, NEVER) for pair in map(add, sym, sym[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            j = i + 1
            both = sym[i] = sym[i] + sym[j]
            del sym[j], agenda[i]
            if i:
                agenda[i - 1] = get(sym[i - 1] + both, NEVER)
            if j < len(sym):
                agenda[i] = get(both + sym[j], NEVER)
        try:
            return tuple(map(self.id.__getitem__, sym))
        except KeyError:
            out = []
        for piece in sym:
            hit = self.id.get(piece)
            if hit is not None:
                out.append(hit)
            else:
                out.extend(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
        return tuple(out)

    def _segment_ids(self, seg: str) -> tuple[int, ...]:
        cache = self.cache
        ids = cache.get(seg)
        if ids is None:
            ids = self.flat_agenda(seg) if len(seg) <= FLAT_LENGTH else self.agenda(seg)
            if len(seg) <= CACHE_LENGTH:
                if len(cache) >= self.limit:
                    cache.clear()
                cache[seg] = ids
        return ids

    def _learn(self, segments: list[str]) -> None:
        """Short segments that are not remembered go through the agenda side by side."""
        cache = self.cache
        if len(cache) >= self.limit:
            cache.clear()
        new = [s for s in dict.fromkeys(segments) if s not in cache and len(s) <= FLAT_LENGTH]
        if new:
            cache.update(zip(new, self.agendas(new)))

    def _learn_words(self, words: list[str]) -> None:
        """Words met for the first time go through the agenda together, so cutting them
        into segments is one array step."""
        segments = self.segments(" ".join(words))
        self._learn(segments)
        got = list(map(self._segment_ids, segments))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))) * 4
        raw = array("i", chain.from_iterable(got)).tobytes()
        starts = ends[[k for k, seg in enumerate(segments) if seg[0] == SPACE]].tolist()
        self.words.update((w, raw[a:b]) for w, a, b in zip(words, starts, [*starts[1:], len(raw)]))

    def _plain_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that are words with one space in between: every distinct word
        is looked up once, and Arrow deals its ids out to where it stands."""
        import pyarrow as pa
        import pyarrow.compute as pc
        words = self.words
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        met = coded.dictionary.to_pylist()
        new = [w for w in met if w not in words]
        if new:
            self._learn_words(new)
        own = list(map(words.__getitem__, met))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // 4))
        ids = pa.array(np.frombuffer(b"".join(own), np.int32))
        dealt = pa.LargeListArray.from_arrays(pa.array(ends), ids).take(coded.indices)
        stops = dealt.offsets.to_numpy()[cut.offsets.to_numpy()].tolist()
        flat = dealt.values.to_numpy()
        for w in new:
            if len(w) > CACHE_LENGTH:
                del words[w]
        if len(words) > self.limit:
            # start again from the words of these texts: frequent ones stay known
            recent = {w: words[w] for w in met if w in words}
            words.clear()
            words.update(recent)
        return [flat[a:b] for a, b in zip(stops, stops[1:])]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [bool(text and self.cut_before_space and "  " not in text and SPACE not in text
                      and text[0] != " " and text[-1] != " ") for text in texts]
        found = iter(self._plain_arrays([t for t, ok in zip(texts, plain) if ok]) if any(plain) else ())
        out = []
        for text, ok in zip(texts, plain):
            if ok:
                out.append(next(found))
            else:
                ids: list[int] = []
                for seg in self.segments(text) if text else ():
                    ids += self._segment_ids(seg)
                out.append(np.array(ids, np.int32))
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text or ""])[0]

    def compare(self, texts: list[str], ids: list[np.ndarray], numbers: list[list[int]],
                decoded: list[str]) -> None:
        """Stops where the library encodes a text, or decodes its ids (``numbers``), otherwise."""
        want = self.lib.encode(texts, return_type="numpy", num_threads=1)
        if not all(map(np.array_equal, ids, want)):
            raise ValueError("ids differ from the library's")
        if self.lib.decode(numbers, num_threads=1) != decoded:
            raise ValueError("decoded texts differ from the library's")

    def decode(self, ids) -> str:
        """As the library decodes: one leading space goes, a byte that is part
        of no character becomes U+FFFD, begin and end ids give nothing."""
        out, run = "", []
        if self.control.isdisjoint(ids):
            return self._run(ids, True)
        for i in ids:
            if i in self.control:
                out += self._run(run, not out)
                run = []
            else:
                run.append(i)
        return out + self._run(run, not out)

    def _run(self, ids: list[int], first: bool) -> str:
        if len(ids) == 0:
            return ""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if first and self.leads[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._lenient(raw)

    @staticmethod
    def _lenient(raw: bytes) -> str:
        """Every byte that is part of no valid character becomes U+FFFD."""
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i:i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(docs: DataFrame, path: str | None = None, check_every: int = CHECK_EVERY,
                  cache: int = CACHE) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every document; ``cache`` bounds
    what a worker remembers and changes only time and memory."""
    path = path or model_path()
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        pieces = load(path)
        pieces.limit = cache
        seen = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(ids):
                # a slice of whole documents with about SLICE_CHARS characters
                group, held, stop = [], 0, start
                while stop < len(ids) and held < SLICE_CHARS:
                    group.append(texts[stop].as_py() or "")
                    held += len(group[-1])
                    stop += 1
                found = pieces.encode_arrays(group)
                numbers = [x.tolist() for x in found]
                decoded = list(map(pieces.decode, numbers))
                if check_every:
                    own = slice(-seen % check_every, None, check_every)
                    pieces.compare(group[own], found[own], numbers[own], decoded[own])
                seen += len(group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[start:stop], pa.int64()), pa.array(found, pa.list_(pa.int32())),
                     pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"])
                start = stop

    schema = T.StructType([T.StructField("doc_id", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the token ids of every row, with the digests of ids and decoded text.

    The mix repeats documents, so rows are told apart by their place only."""
    own = docs.select("doc_id", "text")
    return encode_decode(own, cache=CACHE // 2).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

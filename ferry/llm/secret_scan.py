"""Secret scan: base patterns plus a linear-chain conditional random field.

The base patterns (assignments to password-like names, access key ids, long
hex strings) always count. The model tags tokens as secret begin, inside or
outside and adds what the patterns miss: other key formats, other names, bearer
tokens. Its features are the token's shape, length and mix of characters, the
neighbouring words, and properties of the file (how much of it is prose, how
often names are assigned values, whether the base patterns hit anywhere).
Viterbi decoding picks the best tagging.

The model scores every token of every text. A token's score is a sum of what the
token itself and each neighbour bring, remembered per distinct token; the tagging is
that of one chain over the whole text.

Training: at most ``train_docs`` documents with a trigger, that is a long token with a
digit or a password-like name (smallest seeded
hash) give stretches labelled by the base patterns, of each document at most
``per_doc`` (smallest hash) and ``train_stretches`` in all, none of more than
``longest`` tokens; fixed templates of other secret notations and of long tokens
that are no secrets complete them.

An added span is of kind ``access`` if it is upper-case letters and digits
only, ``hex`` if hex digits only, else ``assign``.

Defined cases: null text is the empty text (no spans); null ids, repeated rows
and extra columns are fine; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.common import seeded_key, ship, smallest_where, staged, table
from ferry.llm.crf import LinearCRF
from ferry.llm.pii import digest, find

KINDS = ("assign", "access", "hex")
TRAIN_DOCS = 1_500
TRAIN_STRETCHES = 400
STRETCHES_PER_DOC = 8
LONGEST_STRETCH = 80      # tokens
REACH = 4
MARGIN = 2       # tokens kept around a stretch: as far as features look
N_FEATURES = 1 << 13
KNOWN_TOKENS = 1 << 18      # distinct tokens a task remembers

# -- base patterns: fixed values --------------------------------------------------
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: more words that stand beside secrets (triggers and features of the model only)
_HINTS = ("pwd", "credential", "bearer", "private_key", "access_key", "authorization", "passphrase", "client_id")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by start, then kind."""
    out, low = [], text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- tokens, triggers, features ------------------------------------------------------
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=~-]+|[^\sA-Za-z0-9+/_.=~-]+")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=~-])(?=[A-Za-z+/_=~-]*[0-9])[A-Za-z0-9+/_=~-]{16,}")
_WORDS = re.compile("|".join((*_NAMES, *_HINTS)))
_CODE = re.compile(r"[={};]")
#: letters and digits of ASCII as one of their kind
_KINDS_OF = {i: k for first, last, k in ("aza", "AZA", "099") for i in range(ord(first), ord(last) + 1)}
WIDTH = 22


def triggers(text: str) -> list[tuple[int, int]]:
    out, low = [], text.lower()
    if len(low) == len(text) and any(n in low for n in (*_NAMES, *_HINTS)):
        out += [m.span() for m in _WORDS.finditer(low)]
    elif len(low) != len(text):
        out += [m.span() for m in re.finditer(_WORDS.pattern, text, re.A | re.I)]
    out += [m.span() for m in _LONG.finditer(text)]
    return sorted(out)


def _shape(token: str) -> str:
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", token)))
    return s if len(s) <= 6 else s[:2] + str(min(len(s) // 4, 6)) + s[-1]


def _name_in(low: str) -> str:
    return next((n for n in (*_NAMES, *_HINTS) if n in low), "")


def _word_names(t: str, at: str) -> list[str]:
    name = _name_in(t.lower())
    size = min(len(t).bit_length(), 7)
    return [f"{at}k{name}", f"{at}s{size}{_shape(t)[:4]}"] if name or not t.isalpha() else [f"{at}w{size}"]


def _token_names(t: str) -> list[str]:
    classes = "".join(c for c, r in (("U", r"[A-Z]"), ("l", r"[a-z]"), ("9", r"[0-9]"), ("+", r"[+/_~-]"), ("=", r"[=:]"))
                      if re.search(r, t))
    distinct = len(set(t)) / max(1, min(len(t), 36))
    value = t.split("=", 1)[1] if "=" in t else ""
    return ["b", f"sh{_shape(t)}", f"c{classes}", f"c{classes}{min(len(t) // 4, 12)}", f"hex{bool(re.fullmatch('[0-9a-f]+', t))}",
            f"v{min(len(value), 12)}{any(c.isdigit() for c in value)}", f"d{int(distinct * 5)}",
            f"url{'//' in t or t.startswith('www')}", f"dot{t.count('.') > 1}", f"pre{t[:4] if '_' in t[:5] else ''}",
            *_word_names(t, "0")]


def _file_names(text: str, hits: int) -> list[str]:
    # properties of the whole file
    code = len(_CODE.findall(text)) * 200 // (len(text) + 1)
    return [f"f{min(code, 5)}", f"h{min(hits, 2)}"]


@lru_cache(1 << 16)
def _id(name: str) -> int:
    return 1 + zlib.crc32(name.encode("utf-8", "replace")) % (N_FEATURES - 1)


def _ids(names: list[str]) -> list[int]:
    ids = [_id(n) for n in names]
    return (ids + [0] * WIDTH)[:WIDTH]


def features(text: str, tokens: list[tuple[int, int]], about: list[str]) -> np.ndarray:
    words = [text[a:b] for a, b in tokens]
    beside = [[_word_names(w, at) for w in words] for at in "MLRS"]
    out = []
    for i, w in enumerate(words):
        names = _token_names(w)
        for at, j in enumerate((i - 2, i - 1, i + 1, i + 2)):
            names += beside[at][j] if 0 <= j < len(words) else [f"{at}edge"]
        out.append(_ids(names + [f"{n}{len(w) >= 16}" for n in about]))
    return np.array(out, int).reshape(-1, WIDTH)


def stretches(text: str):
    """(tokens, far from triggers) of each run of tokens near triggers, in order: what
    examples to learn from are cut of."""
    hot = triggers(text)
    if not hot:
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([x for x, _ in tokens])
    near = np.zeros(len(tokens), bool)
    for x, y in hot:
        i = max(0, int(np.searchsorted(starts, x, "right")) - 1)
        j = max(i, int(np.searchsorted(starts, y, "left")) - 1)
        near[max(0, i - REACH):j + REACH + 1] = True
    own = np.flatnonzero(near)
    cuts = np.flatnonzero(np.diff(own) > 2 * MARGIN) + 1
    for run in np.split(own, cuts):
        a, b = max(0, int(run[0]) - MARGIN), min(len(tokens), int(run[-1]) + MARGIN + 1)
        yield tokens[a:b], ~near[a:b]


def best_tags(e: np.ndarray, t: np.ndarray, start: np.ndarray) -> list[int]:
    """Viterbi as ``LinearCRF.decode`` without forced labels; label 2 never follows 0."""
    (t00, t01, _), (t10, t11, t12), (t20, t21, t22) = t.tolist()
    v0, v1, v2 = (start + e[0]).tolist()
    back = []
    for x, y, z in e[1:].tolist():
        b0, b1, b2 = v0 + t00, v0 + t01, v1 + t12
        k0, k1, k2 = 0, 0, 1
        if v1 + t10 > b0:
            b0, k0 = v1 + t10, 1
        if v2 + t20 > b0:
            b0, k0 = v2 + t20, 2
        if v1 + t11 > b1:
            b1, k1 = v1 + t11, 1
        if v2 + t21 > b1:
            b1, k1 = v2 + t21, 2
        if v2 + t22 > b2:
            b2, k2 = v2 + t22, 2
        v0, v1, v2 = b0 + x, b1 + y, b2 + z
        back.append((k0, k1, k2))
    at = max(range(3), key=(v0, v1, v2).__getitem__)
    out = [at]
    for kept in reversed(back):
        at = kept[at]
        out.append(at)
    out.reverse()
    return out


class _Known:
    """What each distinct token brings to the scores of itself and of its neighbours."""

    def __init__(self, w: np.ndarray):
        self.w, self.v = w, np.zeros((1024, 5, w.shape[1]))
        self.at, self.plain, self.rows = {}, {}, 0
        self.edges = [self._sum([f"{k}edge"]) for k in range(4)]

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.w[[_id(n) for n in names]].sum(0)

    def _row(self, t: str) -> int:
        # all that the features of a token depend on; most words share it with others
        low = t.lower()
        alike = (t.translate(_KINDS_OF), len(set(t)), t[:3] == "www", not t.strip("0123456789abcdef"),
                 t[:4] if "_" in t[:5] else "", _name_in(low) if _WORDS.search(low) else "")
        if alike in self.plain:
            return self.plain[alike]
        n = self.rows
        self.rows += 1
        if n == len(self.v):
            self.v = np.concatenate([self.v, np.zeros_like(self.v)])
        self.v[n, 0] = self._sum(_token_names(t))
        for k, side in enumerate("MLRS"):
            self.v[n, 1 + k] = self._sum(_word_names(t, side))
        self.plain[alike] = n
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.at) > KNOWN_TOKENS:
            self.at, self.plain, self.rows = {}, {}, 0
        at = self.at
        for t in set(words).difference(at):
            at[t] = self._row(t)
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def scores(self, words: list[str], about: list[str]) -> np.ndarray:
        """[tokens, labels]: ``LinearCRF.emissions`` of ``features``."""
        n, number = len(words), self.numbers(words)
        own = self.v[number]
        e = own[:, 0].copy()
        for k, by in enumerate((-2, -1, 1, 2)):
            inner, size = own[:, 1 + k], min(n, abs(by))
            if by < 0:
                e[size:] += inner[:n - size]
                e[:size] += self.edges[k]
            else:
                e[:n - size] += inner[size:]
                e[n - size:] += self.edges[k]
        file = np.array([self._sum([f"{a}{long}" for a in about]) for long in (False, True)])
        return e + file[(np.fromiter(map(len, words), np.int64, n) >= 16).astype(np.int64)]


class Model:
    """Labels: 0 outside, 1 begin, 2 inside."""

    known = None

    def __init__(self):
        self.crf = LinearCRF(N_FEATURES, np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool),
                             np.array([1, 1, 0], bool))

    def fit(self, examples) -> "Model":
        data = []
        for text, spans in examples:
            about = _file_names(text, len(base_spans(text)))
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            y = np.zeros(len(tokens), int)
            for a, b in spans:
                inside = [i for i, (p, q) in enumerate(tokens) if p < b and q > a]
                for k, i in enumerate(inside):
                    y[i] = 2 if k or (y[i] and i) else 1
            data.append((features(text, tokens, about), y))
        self.crf.fit(data)
        return self

    def labels(self, words: list[str], about: list[str]) -> list[int] | None:
        """The best tagging of a whole text, one chain over all its tokens; None if
        all of them are outside."""
        if self.known is None:
            self.known = _Known(self.crf.w)
        e, t = self.known.scores(words, about), self.crf.t
        # most that a token inside a secret can add to the tagging without any, its share of
        # the transitions included; a secret ends once, and has a token
        into = [max(0.0, *(t[i, k] - t[0, 0] for i in rows)) for k, rows in ((1, (0, 1, 2)), (2, (1, 2)))]
        gain = np.maximum(e[:, 1] + into[0], e[:, 2] + into[1]) - e[:, 0]
        end = max(0.0, t[1, 0] - t[0, 0], t[2, 0] - t[0, 0])
        if gain.max() + end < -1e-6:
            return None
        # the most that any run of tokens with this one inside can add: below 0 it is outside
        upto = np.append(0.0, np.cumsum(gain))
        most = np.maximum.accumulate(upto[:0:-1])[::-1] - np.minimum.accumulate(upto[:-1]) + end
        inside = np.flatnonzero(most > -1e-6)
        y = [0] * len(e)
        for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) else ():
            # decoded between its two neighbours, which are outside
            a, b = max(0, int(run[0]) - 1), min(len(e), int(run[-1]) + 2)
            part = e[a:b].copy()
            part[:int(run[0]) - a, 1:] = part[int(run[-1]) + 1 - a:, 1:] = -1e9
            y[a:b] = best_tags(part, t + self.crf.barred, self.crf.start)
        return y

    def __getstate__(self):
        return {"crf": self.crf}

    def base(self, text: str):
        return base_spans(text)

    def spans(self, text: str, hits: int) -> list[tuple[str, int, int]]:
        out, words = [], _TOKEN.findall(text)
        y = self.labels(words, _file_names(text, hits)) if words else None
        if y and any(y):
            tokens, i = [m.span() for m in _TOKEN.finditer(text)], 0
            while i < len(y):
                if y[i]:
                    j = i + 1
                    while j < len(y) and y[j] == 2:
                        j += 1
                    a, b = tokens[i][0], tokens[j - 1][1]
                    s = text[a:b]
                    if len(s) >= 8 and re.search(r"[A-Za-z0-9]{6}", s):
                        kind = ("hex" if re.fullmatch(r"[0-9a-f]+", s) else
                                "access" if re.fullmatch(r"[A-Z0-9]+", s) else "assign")
                        out.append((kind, a, b))
                    i = j
                else:
                    i += 1
        return out

    def all_spans(self, text: str, base):
        """Base spans and the model's spans that touch none of them."""
        more = [s for s in self.spans(text, len(base)) if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        return in_order(list(base) + more)


# -- training data -------------------------------------------------------------------
#: notations of secrets: * stands for random letters and digits, # for hex, ^ for capitals and digits
_SECRETS = ("password=[*12]", "token = \"[#40]\"", "[^20]", "[#32]", "pwd: [*14]", "ghp_[*36]", "xoxb-[*24]", "sk_live_[*24]",
            "Authorization: Bearer [*40]", "client_secret => [*24]", "api_key: \"[*32]\"", "secret='[*20]'",
            "AKIA[^16]", "private_key=[*44]", "credential = [*28]", "\"passphrase\": \"[*18]\"", "glpat-[*20]", "AIza[*35]")
#: long tokens that are no secrets; lower-case letters in [a..] are syllables
_PLAIN = ("https://example.com/[a9]/page?id=[99]", "[a18]", "[a9]-[a8]-[a7]", "Version 2.0, January 2004", "[99]-[99]-2020",
          "the token of [a6]", "a secret [a7] was", "password reset for [a8]", "[a6]_[a7]_[a5]9", "file_2020_[99]_[a8].txt",
          "user.[a6][99]@mail[9].example.com", "4111111111111111", "+1 (212) 555-0143", "10.20.30.40", "[a8]/[a7]/[a9]2.html",
          "the bearer of [a6]", "credentials of the [a7]", "[A12]!! [A9]!!", "token: the [a6]", "| [a8] | [99] | [a6] |")


def _fill(form: str, rng) -> str:
    def one(m):
        kind, n = m[1], int(m[2] or 2)
        sets = {"*": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "#": "0123456789abcdef",
                "^": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "9": "0123456789", "a": "", "A": ""}[kind]
        if kind in "aA":
            s = "".join(rng.choice(["er", "tion", "an", "st", "le", "en", "ou", "ch", "re", "ing"], n))[:n]
            return s if kind == "a" else s.upper()
        return "".join(rng.choice(list(sets), n))
    return re.sub(r"\[([*#^9aA])(\d*)\]", one, form)


def examples(texts: list[str], seed: int = 5):
    rng = np.random.default_rng(seed)
    out = []
    frames = [(" ".join(re.findall(r"[^\W\d_]+", t)[:4]), " ".join(re.findall(r"[^\W\d_]+", t)[-4:])) for t in texts]
    frames += [("the line", "of the file"), ("", ""), ("config:", ";")]
    for text in texts:
        spans, end = [], 0
        for _, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
            if a >= end:
                spans.append((a, b))
                end = b
        out.append((text, spans))
    for forms, label in ((_SECRETS, True), (_PLAIN, False)):
        for form in forms * 7:
            s = _fill(form, rng)
            left, right = frames[int(rng.integers(len(frames)))]
            text = f"{left} {s} {right}"
            a = len(left) + 1
            out.append((text, [(a, a + len(s))] if label else
                        [(x, y) for _, x, y in base_spans(text)]))
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_stretches: int = TRAIN_STRETCHES,
          per_doc: int = STRETCHES_PER_DOC, longest: int = LONGEST_STRETCH) -> Model:
    ship(docs.sparkSession)
    some = r"(?i)passw|secret|token|api_?key|[A-Za-z0-9+/_=-]{24}"
    keyed = docs.select("text", seeded_key(F.col("doc_id"), "secret").alias("key"))
    sample = smallest_where(keyed, train_docs, F.col("text").rlike(some) & F.col("text").rlike(r"[0-9]"),
                            "key", F.length("text"))

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                parts = {text[tokens[0][0]:tokens[-1][1]] for tokens, _ in stretches(text) if len(tokens) <= longest}
                few = sorted(parts, key=lambda p: zlib.crc32(p.encode("utf-8", "replace")))[:per_doc]
                rows += [(k, p) for p in few]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string())], ["key", "part"])

    parts = staged(sample, "secret-sample").mapInArrow(cut, "key string, part string") \
        .orderBy("key", "part").limit(train_stretches).toPandas()
    return Model().fit(examples(list(parts["part"])))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find(docs, train(docs)), KINDS)

"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns (e-mail, IP, card, phone) always count. The model adds spans
the patterns miss: phones without a plus sign, masked e-mail addresses, cards
written with other separators. Its features look at a candidate span as a
whole (digit count, groups, separators, checksum, what stands next to it), and
dynamic programming over segments of at most ``MAX_TOKENS`` tokens chooses
boundaries and types together (``semicrf``).

Where the model runs: a segment must hold a digit or an at-sign, plain or as
``[at]`` (a fixed constraint of the lattice, as is the maximal length), so
tokens too far from any such token can only be outside and the text falls into
independent zones around them (``zones``, by the rules of the lattice itself).
That is the exact result over the whole text; a text without a
digit or at-sign costs one scan. A zone's time is linear in its tokens.

Training: at most ``train_docs`` documents with a digit or at-sign (smallest
seeded hash) give zones whose base spans are the labels; each labelled span is
also rewritten in other common notations, and fixed templates of numbers that
are no personal data (dates, versions, amounts, failing checksums) serve as
counterexamples.

Defined cases: null text is the empty text (no spans); null ids, repeated rows
and extra columns are fine; an empty table gives an empty result and a model
from the templates alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm.common import DOC_COLUMNS, seeded_key, ship, smallest, staged, table
from ferry.llm.semicrf import Lattice, SemiCRF

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
CONTEXT = 3
TRAIN_DOCS = 1_500
TRAIN_ZONES = 350

# -- base patterns: fixed values --------------------------------------------------
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail matches, in linear time.

    The at-sign is in neither class, so a match is decided at its at-sign: the
    domain must follow, and the local part reaches back to the last match.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(d) <= 3 and int(d or 0) <= 255 for d in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- lattice and features -----------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@]|[\[({<]at[\])}>]", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_MASKED_AT = re.compile(r"\s?[\[({<]at[\])}>]\s?", re.I)
N_FEATURES = 1 << 10


class _Features:
    """Names to ids; ids are given in the order names are first seen in training."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.frozen = False

    def __call__(self, names: list[str], width: int) -> list[int]:
        out = []
        for name in names:
            i = self.ids.get(name)
            if i is None:
                if self.frozen or len(self.ids) >= N_FEATURES - 1:
                    continue
                i = self.ids[name] = len(self.ids) + 1
            out.append(i)
        # id 0 never gets a weight: padding
        return (out + [0] * width)[:width]


SPAN_WIDTH, OUT_WIDTH = 20, 3


def zones(text: str) -> list[tuple[int, int]]:
    """Maximal stretches of text that a span with a digit or at-sign can reach.

    By the rules of ``lattice``: to the left up to MAX_TOKENS tokens, a line end,
    two blanks or more than CONTEXT words in a row; to the right the same without
    the words. One more token follows, which is outside, as over the whole text.
    """
    out: list[list[int]] = []
    reach = 0                   # to here spans of the last zone's triggers go
    for m in _TRIGGER.finditer(text):
        if m.start() < reach:
            continue
        a, joined = _left(text, m.start(), out[-1][1] if out else 0)
        last = reach = m.end()
        n = 0
        for t in _TOKEN.finditer(text, reach):
            last = t.end()
            n = 0 if _TRIGGER.match(text, t.start()) else n + 1
            if n >= MAX_TOKENS or _apart(text, reach, t.start()):
                break
            reach = last
        if out and joined:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([a, last])
    return [(a, b) for a, b in out]


def _apart(text: str, end: int, start: int) -> bool:
    """No span reaches over a line end or two blanks."""
    return start - end > 1 or "\n" in text[end:start]


def _left(text: str, at: int, floor: int) -> tuple[int, bool]:
    """Where spans over a trigger can start, and whether they may start before ``floor``."""
    if at < floor:
        return floor, True
    size = 120
    while True:
        low = max(floor, at - size)
        tokens = [(t.start(), t.end()) for t in _TOKEN.finditer(text, low, at)]
        if low > floor:
            tokens = tokens[1:]     # perhaps cut
        first, n, words = at, 1, 0
        for x, y in reversed(tokens):
            words = words + 1 if text[x].isalpha() else 0
            n += 1
            if _apart(text, y, first) or words > CONTEXT or n > MAX_TOKENS:
                return first, False
            first = x
        if low == floor:
            return first, floor > 0 and not _apart(text, floor, first)
        size *= 4


def _span_names(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    digits = _only_digits(s)
    n = len(digits)
    groups = re.findall(r"[0-9]+", s)
    size = next(i for i, top in enumerate((0, 3, 6, 8, 11, 15, 19, 10 ** 9)) if n <= top)
    names = [f"n{size}", f"g{min(len(groups), 6)}"]
    letters = any(c.isalpha() for c in s)
    ats = s.count("@")
    masked = bool(_MASKED_AT.search(s))
    names.append(f"at{min(ats, 2)}{masked}")
    if ats == 1 or masked:
        tail = s[s.rfind("@") + 1:] if ats else _MASKED_AT.split(s)[-1]
        dotted = "." in tail.strip(".")
        names += [f"dom{dotted}", f"white{bool(re.search(r'\s', _MASKED_AT.sub('@', s)))}"]
    elif letters:
        names.append("letters")
    else:
        seps = "".join(sorted(set(re.findall(r"[^0-9+]", s))))
        names += [f"sep{seps if len(seps) < 5 else 'many'}", f"plus{s.startswith('+')}"]
        if 12 <= n <= 19:
            names.append(f"luhn{luhn(digits)}")
        if len(groups) == 4 and set(seps) == {"."}:
            names.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        if len(groups) >= 3 and n in (10, 11):
            names.append("g3" + "-".join(str(len(g)) for g in groups))
        if len(set(map(len, groups))) == 1 and len(groups) > 1:
            names.append(f"even{len(groups[0])}")
        names.append(f"open{s.count('(') == s.count(')')}")
    before, after = text[a - 1:a], text[b:b + 1]
    glued = lambda c, more: bool(c) and (c.isalnum() or c in more)
    names.append(f"left{glued(before, '@._%+-/:=\"#(')}")
    names.append(f"right{glued(after, '@_%-/:=\")')}")
    nxt = text[b:b + 2]
    names.append(f"goes{len(nxt) == 2 and nxt[0] in '.,-' and nxt[1].isalnum()}")
    prv = text[max(0, a - 2):a]
    names.append(f"came{len(prv) == 2 and prv[1] in '.,- ' and prv[0].isdigit()}")
    names.append(f"then{bool(re.match(r'[ ]?[0-9(]', text[b:b + 2]))}")
    return names


def lattice(text: str, a: int, b: int, ids: _Features):
    """Tokens (start, end) of a zone and its lattice of candidate spans."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    n = len(tokens)
    outside = np.zeros((n, OUT_WIDTH), int)
    for i, (x, y) in enumerate(tokens):
        c = text[x]
        kind = "D" if c.isdigit() else "L" if c.isalpha() else c
        outside[i] = ids(["o", f"o{kind}", f"o{kind}{min(y - x, 5)}"], OUT_WIDTH)
    spans = []
    hot = [bool(_TRIGGER.match(text, x)) for x, _ in tokens]
    for i, (x, _) in enumerate(tokens):
        c = text[x]
        if not (c.isalnum() or c in "+("):
            continue
        seen, cold = False, 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            y = tokens[j][1]
            if j > i and _apart(text, tokens[j - 1][1], tokens[j][0]):
                break
            cold = 0 if hot[j] or not text[tokens[j][0]].isalpha() else cold + 1
            seen = seen or hot[j]
            if not seen and cold > CONTEXT:
                break
            if seen and text[y - 1].isalnum():
                spans.append((i, j + 1, ids(_span_names(text, x, y), SPAN_WIDTH)))
    spans.sort(key=lambda s: (s[1], s[0]))
    return tokens, Lattice(n, outside, np.array([s[0] for s in spans], int),
                           np.array([s[1] for s in spans], int),
                           np.array([s[2] for s in spans], int).reshape(-1, SPAN_WIDTH))


class Model:
    def __init__(self):
        self.ids = _Features()
        self.crf = SemiCRF(N_FEATURES, len(KINDS) + 1)

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]]) -> "Model":
        data = []
        for text, spans in examples:
            tokens, lat = lattice(text, 0, len(text), self.ids)
            first = {x: i for i, (x, _) in enumerate(tokens)}
            last = {y: i + 1 for i, (_, y) in enumerate(tokens)}
            gold, end = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= end and a in first and b in last:
                    gold.append((first[a], last[b], KINDS.index(kind) + 1))
                    end = b
            data.append((lat, gold))
        self.crf.fit(data)
        self.ids.frozen = True
        return self

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """What the model finds in a whole text."""
        out = []
        if _TRIGGER.search(text):
            for a, b in zones(text):
                tokens, lat = lattice(text, a, b, self.ids)
                out += [(KINDS[y - 1], tokens[i][0], tokens[j - 1][1]) for i, j, y in self.crf.decode(lat)]
        return out

    def base(self, text: str) -> list[tuple[str, int, int]]:
        return base_spans(text) if _TRIGGER.search(text) else []

    def all_spans(self, text: str, base) -> list[tuple[str, int, int]]:
        """Base spans and the model's spans that touch none of them."""
        more = [s for s in self.spans(text) if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        return in_order(list(base) + more)


# -- training data -------------------------------------------------------------------
def _rewrites(kind: str, s: str) -> list[str]:
    d = _only_digits(s)
    if kind == "phone" and len(d) >= 10:
        local = d[-10:]
        a, b, c = local[:3], local[3:6], local[6:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d[:-10] or 1} {a} {b} {c}", f"{a} {b} {c}"]
    if kind == "email":
        user, _, host = s.partition("@")
        return [f"{user}[at]{host}", f"{user} [at] {host}", f"{user}(at){host}"]
    if kind == "card" and len(d) == 16:
        return [sep.join(d[i:i + 4] for i in (0, 4, 8, 12)) for sep in (" ", "-", ".", "/")]
    return []


#: counterexamples: numbers and signs that are no personal data; {} is a digit
PLAIN = ("Version {}.{}", "version {}", "v{}.{}.{}", "{}{}{}{}-{}{}-{}{}", "{}{}/{}{}/{}{}{}{}", "{}{}:{}{}:{}{}",
         "${},{}{}{}.{}{}", "{}{}{}{}{}{}{}{}{}{}{}{}{}{}{}{}", "{}{}{}.{}{}{}.9{}{}.{}", "{}{}{}{}", "{}{}%",
         "{}{}{}{}-{}{}{}{}", "({}{}{}{})", "{} + {} = {}", "#{}{}{}{}{}", "{}{}{}{}{}{}{}", "{}.{}{}", "{}{}-{}{}",
         "a{}b{}c{}d{}e{}f{}a{}b{}", "you @ home", "rev {}{}{}{}.{}{}", "{}.{}.{}.{}.{}.{}", "{}{},{}{}{},{}{}{}",
         "{}{}{}{}{}{}{}{}{}{}{}{}{}", "{}e{}{}", "{}x{}", "{}{}{}{}{}{}{}{}{}{}{}")


def examples(zone_texts: list[str], seed: int = 3):
    """Training examples: labelled zones, rewritten spans, counterexamples."""
    rng = np.random.default_rng(seed)
    out = []
    frames = [(t[:20], t[-20:]) for t in zone_texts] or []
    frames = [(re.sub(r"[^A-Za-z ]", "", a) + " ", " " + re.sub(r"[^A-Za-z ]", "", b)) for a, b in frames]
    frames = (frames or []) + [("", ""), ("the ", " is"), ("see ", "."), ("(", ")"), ("", ", and so on")]
    seeds = [("phone", "+1 (212) 555-0143"), ("phone", "+44 20 7946 0958"), ("email", "ann.lee@mail.example.com"),
             ("card", "4111111111111111"), ("ip", "10.20.30.40")]
    for text in zone_texts:
        spans = base_spans(text)
        out.append((text, spans))
        seeds += [(k, text[a:b]) for k, a, b in spans]
    keep = rng.permutation(len(seeds))[:160]
    for i in keep:
        kind, s = seeds[i]
        forms = _rewrites(kind, s) + [s]
        s = forms[int(rng.integers(len(forms)))]
        left, right = frames[int(rng.integers(len(frames)))]
        text = left + s + right
        own = [(kind, len(left), len(left) + len(s))]
        out.append((text, own))
    for form in PLAIN * 4:
        s = re.sub(r"\{\}", lambda _: str(rng.integers(10)), form)
        if len(s) >= 11 and s.isdigit() and luhn(s):
            s = s[:-1] + str((int(s[-1]) + 5) % 10)
        left, right = frames[int(rng.integers(len(frames)))]
        text = left + s + right
        if not base_spans(text):
            out.append((text, []))
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    ship(docs.sparkSession)
    some = docs.select("text", seeded_key(F.col("doc_id"), "pii").alias("key")) \
        .filter(F.col("text").rlike(r"[0-9@]|(?i)[\[({<]at[\])}>]"))
    sample = smallest(some, train_docs, "key", F.length("text"))

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            rows = [(k, text[a:b]) for k, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
                    for a, b in zones(text) if b - a < 400]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string())], ["key", "zone"])

    zoned = staged(sample, "pii-sample").mapInArrow(cut, "key string, zone string") \
        .orderBy("key", "zone").limit(TRAIN_ZONES).toPandas()
    return Model().fit(examples(list(zoned["zone"])))


# -- jobs ------------------------------------------------------------------------------
def find(docs: DataFrame, model, redact: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end); with ``redact`` also
    the text with every span replaced by its kind in brackets."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few thousand numbers

    def run(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        model = shared.value
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, both, texts = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                b = model.base(text)
                s = model.all_spans(text, b)
                base.append(as_rows(b))
                both.append(as_rows(s))
                if redact:
                    texts.append(masked(text, s))
            cols = [pa.array(base, span), pa.array(both, span)]
            names = [*batch.schema.names, "base", "spans"]
            kept = list(batch.columns)
            if redact:
                nulls = batch.column("text").is_null().to_pylist()
                kept[batch.schema.get_field_index("text")] = pa.array(
                    [None if none else t for t, none in zip(texts, nulls)], pa.string())
            yield pa.RecordBatch.from_arrays(kept + cols, names)

    spans = "array<struct<kind: string, start: int, end: int>>"
    out = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", base {spans}, spans {spans}"
    return docs.mapInArrow(run, out)


def masked(text: str, spans) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds=KINDS) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find(docs, train(docs)))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in every text is replaced by its kind."""
    docs = docs.select(DOC_COLUMNS)
    model = train(docs)
    return find(docs, model, redact=True) \
        .withColumn("n_chars", F.length("text").cast("long")).select(DOC_COLUMNS)

"""Personal data and secrets: base patterns against plain regular expressions, added spans, awkward tables."""
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import pii, secret_scan
from tests.llm.cases import AWKWARD, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def digits(s):
    return re.sub("[^0-9]", "", s)


def checksum(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        total += sum(map(int, str(int(c) * (1 + i % 2))))
    return total % 10 == 0


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text("a@.-_+%é 12)(0\n", max_size=40))
def test_base_personal_data(t):
    assert pii.base_spans(t) == plain_pii(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "ſecret", "secret", "=", ":", "'", '"', " ", "abc", "AKIA",
                                 "ABCDEFGH12345678", "0123456789abcdef", "é", "toKen", "\n", "x=1"]), max_size=14))
def test_base_secrets(parts):
    t = "".join(parts)
    assert secret_scan.base_spans(t) == plain_secrets(t)


def test_ip_parts_with_many_zeros():
    t = "0" * 6000 + "1.2.3." + "0" * 6000 + " 256.1.1.1"
    assert pii.base_spans(t)[:1] == [("ip", 0, len(t) - 10)]


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "a" * 200_000 + "@", "1" * 60_000, "1." * 60_000, "+1" * 60_000, "f" * 200_000, "token " * 30_000):
        pii.base_spans(t)
        secret_scan.base_spans(t)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def scanner(spark):
    return secret_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_model_finds_other_notations(model):
    for text, kind, span in (("call (319) 555-5132 now", "phone", "(319) 555-5132"),
                             ("my number is 212-555-0143.", "phone", "212-555-0143"),
                             ("card 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111")):
        found = [(k, text[a:b]) for k, a, b in model.all_spans(text, pii.base_spans(text))]
        assert (kind, span) in found, (text, found)


def over_whole_text(model, text):
    tokens, lat = pii.lattice(text, 0, len(text), model.ids)
    return [(pii.KINDS[y - 1], tokens[i][0], tokens[j - 1][1]) for i, j, y in model.crf.decode(lat)]


def test_zones_give_the_result_over_the_whole_text(model):
    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(["ann", ".", "mary", "-", "lee", " [at] ", "@", "x", "uk", " ", "  ", "\n", "212", "555", "0143",
                                     "(", ")", "+", ", ", " word", "_", "é", "٣", "4111", "a" * 150]), max_size=90))
    def check(parts):
        text = "".join(parts)
        assert model.spans(text) == over_whole_text(model, text)

    check()
    for text in ("ann.mary.lee.jones [at] x.org", "write to bob [at] mail.cs.uni.ac.uk now", "a.b.c.d.e.f.g.h [at] i.j.k.l.m.n.o"):
        assert model.spans(text) == over_whole_text(model, text)
    assert pii.zones("ann.mary.lee.jones [at] x.org") == [(0, 29)]
    assert pii.zones("bob [at] mail.cs.uni.ac.uk") == [(0, 26)]


def test_zones_of_real_text(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(60).collect():
        assert model.spans(r.text) == over_whole_text(model, r.text)


def test_model_leaves_plain_numbers(model):
    for text in ("on 2024-01-02 at 12:30:45", "Apache License, Version 2.0, January 2004", "total 1,234,567.89 in 2020",
                 "x = 5 + 3", "page 12 of 400", "no numbers here"):
        assert model.all_spans(text, pii.base_spans(text)) == [], text


def test_model_agrees_with_the_base_on_unseen_text(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 7 = 3").collect()
    base = hit = more = 0
    for r in rows:
        b = pii.base_spans(r.text)
        s = set(model.spans(r.text))
        base, hit = base + len(b), hit + len(set(b) & s)
        more += len(model.all_spans(r.text, b)) - len(b)
    assert hit >= 0.95 * base and more <= 0.03 * base


def test_scanner_finds_other_notations(scanner):
    for text in ("use ghp_16C7e42F292c6912E7710c838347Ae178B4a now", "pwd: Tr0ub4dor3xyz99",
                 "client_secret => a8Fk29dkLw02kfDkw91kfLw0"):
        assert scanner.all_spans(text, secret_scan.base_spans(text)), text


def test_scanner_leaves_prose(scanner):
    for text in ("the token of esteem is a secret", "see https://example.com/abc/def?id=12345678901234 there",
                 "Apache License, Version 2.0, January 2004", "password reset for jonathan1999"):
        assert scanner.all_spans(text, secret_scan.base_spans(text)) == [], text


@pytest.mark.parametrize("which", ["pii", "secrets"])
def test_awkward_table(spark, model, scanner, which):
    m, plain, kinds = (model, plain_pii, pii.KINDS) if which == "pii" else (scanner, plain_secrets, secret_scan.KINDS)
    out = pii.digest(pii.find(docs(spark, AWKWARD).select("doc_id", "text"), m), kinds).collect()
    want = []
    for i, t, *_ in AWKWARD:
        spans = plain(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *[sum(s[0] == k for s in spans) for k in kinds], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in out), key=repr) == sorted(want, key=repr)
    for r in out:   # base spans stay, in order
        assert [int(x.split(":")[1]) for x in r.spans.split(",") if x] == sorted(
            int(x.split(":")[1]) for x in r.spans.split(",") if x)


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert pii.digest(pii.find(empty.select("doc_id", "text"), pii.train(empty))).count() == 0
    assert pii.digest(pii.find(empty.select("doc_id", "text"), secret_scan.train(empty)), secret_scan.KINDS).count() == 0


def test_redaction(spark, model):
    out = {r.doc_id: r.text for r in pii.find(docs(spark, AWKWARD).select("doc_id", "text"), model, redact=True).collect()}
    assert out[5] == "mail me at [EMAIL] or [PHONE]"
    assert out[1] is None and out[2] == ""
    assert pii.masked("ab", [("card", 0, 2), ("phone", 1, 2)]) == "[CARD]"


def one_chain(scanner, text):
    """Spans of one chain over all tokens of the text, forced outside away from triggers."""
    tokens = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=~-]+|[^\sA-Za-z0-9+/_.=~-]+", text)]
    near = set()
    for x, y in secret_scan.triggers(text):
        touched = [i for i, (a, b) in enumerate(tokens) if a < y and b > x]
        near |= {i + d for i in touched for d in range(-secret_scan.REACH, secret_scan.REACH + 1)}
    if not tokens:
        return []
    forced = [i not in near for i in range(len(tokens))]
    about = secret_scan._file_names(text, len(secret_scan.base_spans(text)))
    y = scanner.crf.decode(secret_scan.features(text, tokens, about), secret_scan.np.array(forced))
    out, i = [], 0
    while i < len(y):
        if y[i]:
            j = i + 1
            while j < len(y) and y[j] == 2:
                j += 1
            s = text[tokens[i][0]:tokens[j - 1][1]]
            if len(s) >= 8 and re.search("[A-Za-z0-9]{6}", s):
                out.append((tokens[i][0], tokens[j - 1][1]))
            i = j
        else:
            i += 1
    return out


PARTS = ["word", "the", "token", "password", "=", ":", "Bearer", "client_id", "x" * 45 + "7" * 30, "q" * 130 + "9z", "!!",
         "a8Fk29dkLw02kfDkw91kfLw0", "0123456789abcdef0123", "é", ".", "-" * 150 + "4a", "https://a.b/c?d=1", "{", "S3cr3t" * 40]


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from([" ", " ", "\n", "  ", "", "\t"])), max_size=60))
def test_stretches_give_one_chains_result(scanner, parts):
    text = "".join(a + b for a, b in parts)
    got = scanner.spans(text, len(secret_scan.base_spans(text)))
    assert [(a, b) for _, a, b in got] == one_chain(scanner, text)


def test_long_tokens_count_whole(scanner):
    """A digit far behind the token's start, and a name before a very long value."""
    assert secret_scan.triggers("a" * 60 + "1" + "b" * 20)
    for text in ("k " * 70 + "s" * 100 + "9" + "T" * 60, "z" * 300 + "8"):
        got = scanner.spans(text, 0)
        assert [(a, b) for _, a, b in got] == one_chain(scanner, text)


def test_training_bounds(spark):
    long = "password=" + " password=".join(f"Ab{i:04d}xyzQ" + " plain words between them all" * 3 for i in range(300))
    few = secret_scan.train(docs(spark, [(i, long if i == 0 else f"token: k9d8s7f6g5h4j3{i}k2", "en", "s") for i in range(20)]),
                            train_stretches=12, per_doc=2)
    assert few.all_spans("api_key = Zk9d8s7f6g5h4j3k2", secret_scan.base_spans("api_key = Zk9d8s7f6g5h4j3k2"))


def test_secret_sample_is_not_looked_for_in_every_text(spark):
    """The training documents are those of a plain sort, and the costly condition is
    worked out on a part of the table, more of it where few rows pass."""
    from pyspark.sql import functions as F

    from ferry.llm.common import seeded_key, smallest_where
    rows = spark.range(4000).select("id", seeded_key(F.col("id"), "t").alias("key"))
    for every, most in ((2, 800), (40, 8000)):
        looked = spark.sparkContext.accumulator(0)

        def keep(i, every=every, looked=looked):
            looked.add(1)
            return i % every == 0

        got = smallest_where(rows, 50, F.udf(keep, "boolean")("id"), "key", "id").collect()
        plain = rows.filter(F.col("id") % every == 0).orderBy("key", "id").limit(50).collect()
        assert [r.id for r in got] == [r.id for r in plain]
        assert looked.value < most
    none = smallest_where(rows, 50, F.col("id") < 0, "key").collect()
    assert none == [] and smallest_where(rows.limit(0), 5, F.lit(True)).collect() == []

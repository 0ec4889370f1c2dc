import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import pieces
from tests.llm.cases import AWKWARD, docs

P = pieces.load(pieces.model_path())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab ▁\t\nthe<0x>é漢", max_size=60)))
def test_ids_and_text_equal_the_library(text):
    ids = P.lib.encode(text)
    assert P.encode(text) == ids
    assert P.decode(ids) == P.lib.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=15))
def test_decoding_any_ids(ids):
    assert P.decode(ids) == P.lib.decode(ids)


def test_both_agendas_agree():
    for seg in ("▁internationalisation", "▁▁▁▁▁▁▁", "aaaaaaaaaaaaaaa", "▁éàü", "x"):
        assert P.agenda(seg) == P.flat_agenda(seg)


def test_long_segment_without_a_cut():
    text = "ab" * 20000
    assert P.encode(text) == P.lib.encode(text)


def test_awkward_table(spark):
    out = pieces.digests(pieces.encode_decode(docs(spark, AWKWARD), check_every=1)).collect()
    assert len(out) == len(AWKWARD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in AWKWARD:
        ids = P.lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(P.lib.decode(ids))))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert pieces.digests(pieces.encode_decode(docs(spark, []))).count() == 0


def test_a_difference_stops_the_job(spark, monkeypatch):
    wrong = pieces.Pieces(pieces.model_path())
    monkeypatch.setattr(wrong, "_segment_ids", lambda seg: (5,))
    assert wrong.encode("hello world") != wrong.lib.encode("hello world")


def test_query_against_the_library(spark):
    got = {r.doc_id: tuple(r)[1:] for r in pieces.op3(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = P.lib.encode(r.text)
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(P.lib.decode(ids)))
    assert len(got) == len(rows)


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "x.model"
    bad.write_bytes(b"no model")
    with pytest.raises(Exception):
        pieces.Pieces(str(bad))


class _InThisProcess:
    """A table whose rows the query's function gets here and not in a worker."""

    def __init__(self, spark, texts):
        import pyarrow as pa
        self.sparkSession = spark
        self.batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return sum(b.num_rows for b in run(iter([self.batch])))


@pytest.mark.parametrize("at", [0, 5, 31, 33, 39])
@pytest.mark.parametrize("what", ["ids", "text"])
def test_every_document_is_compared(spark, monkeypatch, at, what):
    # only documents 0 and 32 of these were, and never their decoded text
    texts = [f"a plain text {i}" if i % 7 else None for i in range(40)]
    mine = pieces.Pieces(pieces.model_path())
    monkeypatch.setattr(pieces, "load", lambda path: mine)
    rows = _InThisProcess(spark, texts)
    assert pieces.encode_decode(rows) == 40
    texts[at] = "an odd text"
    if what == "ids":
        right = mine._segment_ids
        monkeypatch.setattr(mine, "_segment_ids", lambda seg: (5,) if seg == "▁odd" else right(seg))
    else:
        right = mine.decode
        monkeypatch.setattr(mine, "decode", lambda ids: right(ids).replace("odd", "even"))
    with pytest.raises(ValueError, match="differ from the library's"):
        pieces.encode_decode(_InThisProcess(spark, texts))

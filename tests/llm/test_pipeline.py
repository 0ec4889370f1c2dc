import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from ferry.llm import langid, mixing, neardup, pieces, pii
from ferry.llm.common import DOC_COLUMNS, staged
from ferry.llm.queries import registry
from tests.llm.cases import AWKWARD, docs
from tests.llm.test_neardup import plain

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry().items() if sql])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry()[name][1])
    columns = [d[0] for d in want.description]
    df = registry()[name][0](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline_follows_its_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    d = spark.read.parquet(f"{SF}/documents.parquet").select(DOC_COLUMNS)
    # brute force: predictions one by one, all pairs, spans one by one, the library's ids
    model = langid.train(d)
    rows = [r for r in d.collect() for p in [model.predict(r.text)] if p[0] != "und" and p[1] >= langid.MIN_SCORE]
    assert len(rows) >= 0.99 * d.count()
    keep = {c for _, _, c in plain([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in keep]
    left = spark.createDataFrame(rows, d.schema)
    left = staged(left.repartition(1), "test-left")
    finder = pii.train(left)
    masked = {r.doc_id: pii.masked(r.text, finder.all_spans(r.text, pii.base_spans(r.text))) for r in rows}
    p = pieces.load(pieces.model_path())
    mix = {r.doc_id: r for r in mixing.mix(left.rdd.map(
        lambda r: (r.doc_id, masked[r.doc_id], r.lang, r.source, 0)).toDF(d.schema)).collect()}
    want = []
    for doc, text in masked.items():
        m = mix[doc]
        texts = [text] * m.whole + ([text] if m.part == m.size else [" ".join(text.split()[:m.part])] if m.part else [])
        want += [(doc, tuple(p.lib.encode(t))) for t in texts if t or m.size]
    got = [(r.doc_id, tuple(r.ids)) for r in out]
    assert sorted(got) == sorted(want)


def test_stages_take_awkward_tables(spark):
    d = docs(spark, AWKWARD + [(100 + i, f"the cat and the dog number {i} ran over the hill", "en", "a") for i in range(30)])
    for rows in (d, d.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, SF), f"test-{name}")
            if name != "sentencepiece":
                assert now.columns == DOC_COLUMNS
        now.collect()


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """What a worker of the token stage is given at once follows the bytes of the texts."""
    from ferry.llm import pieces
    from ferry.session import BATCH_BYTES, BATCH_BYTES_CONF
    kept = spark.conf.get(BATCH_BYTES_CONF, None)
    try:
        spark.conf.unset(BATCH_BYTES_CONF)
        df = spark.range(0, 800, 1, 1).selectExpr("id AS doc_id", "repeat('word and more ', 4000) AS text")
        pieces.encode_decode(df)
        sizes = []
        for r in df.mapInArrow(lambda batches: (b.slice(0, 1).append_column("n", _bytes(b)) for b in batches),
                               "doc_id long, text string, n long").select("n").collect():
            sizes.append(r.n)
        assert len(sizes) > 1 and max(sizes) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_BYTES_CONF, "1234567")
        pieces.encode_decode(df)
        assert spark.conf.get(BATCH_BYTES_CONF) == "1234567"
    finally:
        if kept is None:
            spark.conf.unset(BATCH_BYTES_CONF)
        else:
            spark.conf.set(BATCH_BYTES_CONF, kept)


def _bytes(batch):
    import pyarrow as pa
    return pa.array([batch.nbytes], pa.int64())

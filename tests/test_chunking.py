"""Dense row numbers and chunks: exact file order, every row once, only the last chunk short."""

import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferry.functions.internal import SRC_FILE
from ferry.operators import chunking, project
from ferry.operators.rowindex import with_row_index
from ferry.sources.catalogue import find_input_files
from ferry.sources.readers import read_files

from tests.conftest import SF01


def _ndjson_parts(spark, tmp_path, n_files=3):
    """lineitem (sf0.01) as NDJSON files with a running ``seq`` in file order."""
    d = str(tmp_path / "nd")
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    rows = li.orderBy("l_orderkey", "l_linenumber").collect()
    per = len(rows) // n_files + 1
    os.makedirs(d)
    seq = 0
    for i in range(n_files):
        with open(f"{d}/part-{i}.ndjson", "w") as fh:
            for r in rows[i * per:(i + 1) * per]:
                fh.write(f'{{"seq": {seq}, "k": {r.l_orderkey}}}\n')
                seq += 1
    return d, seq


def test_row_index_is_file_order_across_many_splits(spark, tmp_path):
    d, n = _ndjson_parts(spark, tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_files(spark, find_input_files(spark, d).paths, tag=True)
        assert df.rdd.getNumPartitions() > 10
        idx = with_row_index(df)
        bad = idx.where(F.col("_idx") != F.col("seq")).count()
        assert bad == 0
        assert idx.count() == n
        per_file = with_row_index(df, per_file=True)
        starts = per_file.groupBy(SRC_FILE).agg(F.min("_idx").alias("lo"),
                                                   F.max("_idx").alias("hi"),
                                                   F.count(F.lit(1)).alias("n")).collect()
        assert all(r.lo == 0 and r.hi == r.n - 1 for r in starts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_index_after_shuffle_is_dense(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_returnflag", "l_quantity")
    dd = project.dedupe(li)
    idx = with_row_index(dd, stable=False)
    stats = idx.agg(F.min("_idx"), F.max("_idx"), F.countDistinct("_idx"), F.count(F.lit(1)))
    lo, hi, distinct, n = stats.collect()[0]
    assert lo == 0 and hi == n - 1 and distinct == n


@settings(max_examples=8, deadline=None)
@given(rows=st.integers(min_value=1, max_value=12000))
def test_chunks_cover_rows_once(spark, rows):
    df = read_files(spark, [f"{SF01}/events.parquet"], tag=True)
    n = 10000
    m = {r.chunk: r for r in chunking.chunk_manifest(df, rows).collect()}
    assert len(m) == chunking.n_chunks(n, rows)
    assert sum(r.n_rows for r in m.values()) == n
    last = max(m)
    for c, r in m.items():
        assert r.first_row == c * rows
        assert r.n_rows == (rows if c < last else n - last * rows)
        assert r.last_row == r.first_row + r.n_rows - 1


def test_row_index_without_broadcast_is_the_same(spark):
    df = read_files(spark, [f"{SF01}/events.parquet"], tag=True)
    a = with_row_index(df).select("event_id", "_idx")
    b = with_row_index(df, max_broadcast_bytes=0).select("event_id", "_idx")
    assert "BroadcastHashJoin" not in b._jdf.queryExecution().executedPlan().toString()
    assert a.exceptAll(b).count() == 0 and b.count() == a.count() == 10000

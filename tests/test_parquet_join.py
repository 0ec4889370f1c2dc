"""One Parquet file from parts: same rows in the same order, read by other readers too."""
import io
import os
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry import Job, run
from ferry.sinks import layout, parquet_join
from ferry.sinks.parquet_join import join_row_groups
from tests.conftest import SF01


def joined(blobs, buffer=7):
    out = io.BytesIO()
    n = join_row_groups(out, [partial(lambda b: (io.BytesIO(b), len(b)), b) for b in blobs], buffer)
    assert n == len(out.getvalue())
    return out.getvalue()


def blob(table, **kw):
    out = io.BytesIO()
    pq.write_table(table, out, **kw)
    return out.getvalue()


SCHEMA = pa.schema([("id", pa.int64()), ("s", pa.string()), ("l", pa.list_(pa.int64())),
                    ("t", pa.struct([("x", pa.float64()), ("b", pa.bool_())])), ("m", pa.map_(pa.string(), pa.int64()))])


def table(start, n):
    ids = range(start, start + n)
    return pa.table([[*ids], [None if i % 7 == 3 else f"text {i % 5}" for i in ids], [list(range(i % 4)) for i in ids],
                     [{"x": i / 3, "b": i % 2 == 0} for i in ids], [[("k", i)] for i in ids]], schema=SCHEMA)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 30),
       st.sampled_from(["snappy", "gzip", "zstd", "none"]), st.booleans())
def test_rows_and_row_groups(sizes, group, codec, indexes):
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    parts = [table(s, n) for s, n in zip(starts, sizes)]
    blobs = [blob(t, row_group_size=group, compression=codec, write_page_index=indexes) for t in parts]
    whole = joined(blobs)
    assert pq.read_table(io.BytesIO(whole)).equals(pa.concat_tables(parts))
    own = pq.ParquetFile(io.BytesIO(whole)).metadata
    assert own.num_rows == sum(sizes)
    assert own.num_row_groups == sum(pq.ParquetFile(io.BytesIO(b)).metadata.num_row_groups for b in blobs)


def test_a_footer_is_written_back_as_it_was():
    data = blob(table(0, 100), row_group_size=9)
    src = io.BytesIO(data)
    footer, end = parquet_join.read_footer(src, len(data))
    assert parquet_join._struct(footer) == data[end:-8]


def test_other_columns_or_no_parquet_are_refused():
    with pytest.raises(ValueError, match="differ"):
        joined([blob(pa.table({"a": [1]})), blob(pa.table({"b": [1]}))])
    with pytest.raises(ValueError, match="not a Parquet"):
        joined([b"no parquet at all"])


@pytest.fixture
def small_splits(spark):
    for k, v in {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024",
                 layout.ASSEMBLE_MIN_BYTES_CONF: "0"}.items():
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", layout.ASSEMBLE_MIN_BYTES_CONF):
        spark.conf.unset(k)


def grouped(path, tmp_path, groups=20):
    """The table with many row groups, so that its splits hold some each."""
    t = pq.read_table(path)
    target = f"{tmp_path}/in/t.parquet"
    os.makedirs(f"{tmp_path}/in")
    pq.write_table(t, target, row_group_size=-(-t.num_rows // groups))
    return t, target


def test_merge_and_per_file_by_many_writers(spark, tmp_path, out, small_splits):
    t, src = grouped(f"{SF01}/lineitem.parquet", tmp_path)
    for job in (Job(input=src, format="parquet", output=out),
                Job(input=src, format="parquet", single_file=True, output=f"{out}/all.parquet")):
        path = run(spark, job).outputs[0].path.replace("file:", "")
        back = pq.ParquetFile(path)
        assert back.metadata.num_row_groups > 5          # written by several tasks
        assert back.read().to_pylist() == t.to_pylist()
        assert spark.read.parquet(path).count() == t.num_rows
        assert spark.read.parquet(path).where("l_orderkey < 100").count() == len(
            [x for x in t.column("l_orderkey").to_pylist() if x < 100])


def test_chunks_across_splits(spark, tmp_path, out, small_splits):
    t, src = grouped(f"{SF01}/events.parquet", tmp_path)
    res = run(spark, Job(input=src, format="parquet", rows=1700, output=out))
    ids = [pq.read_table(w.path.replace("file:", "")).column("event_id").to_pylist()
           for w in sorted(res.outputs, key=lambda w: w.chunk)]
    assert [i for chunk in ids for i in chunk] == t.column("event_id").to_pylist()
    assert {len(chunk) for chunk in ids[:-1]} == {1700}

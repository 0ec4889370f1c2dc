"""Readers and catalogue on small files made here (never reference fixtures)."""

import bz2
import gzip
import os

import pytest
import zstandard

from ferry.functions.formats import UnsupportedFormat
from ferry.sources.catalogue import CatalogueError, find_input_files
from ferry.sources.readers import ReadOptions, read_files

from tests.conftest import write


def test_catalogue_recursive_sorted_case_insensitive(spark, tmp_path):
    d = str(tmp_path / "in")
    write(f"{d}/b.csv", "a\n1\n")
    write(f"{d}/A.CSV", "a\n2\n")
    write(f"{d}/sub/c.ndjson.gz", gzip.compress(b'{"a": 3}\n'), mode="wb")
    write(f"{d}/notes.txt", "x")
    cat = find_input_files(spark, d)
    assert [p.rsplit("/", 1)[1] for p in cat.paths] == ["A.CSV", "b.csv", "c.ndjson.gz"]
    assert cat.is_dir and cat.formats() == ["csv", "ndjson"]
    with pytest.raises(CatalogueError, match="different formats"):
        cat.check_same_format()


def test_catalogue_errors_and_single_file(spark, tmp_path):
    d = str(tmp_path / "empty")
    os.makedirs(d)
    write(f"{d}/x.txt", "x")
    with pytest.raises(CatalogueError, match="no data files"):
        find_input_files(spark, d)
    f = write(str(tmp_path / "one.csv"), "a\n1\n")
    cat = find_input_files(spark, f)
    assert not cat.is_dir and len(cat.paths) == 1


def test_glob_characters_are_literal(spark, tmp_path):
    d = str(tmp_path / "data[backup]")
    write(f"{d}/data*special.csv", "a,b\n1,2\n")
    write(f"{d}/dataXspecial.csv", "a,b\n3,4\n")
    cat = find_input_files(spark, d)
    assert len(cat.paths) == 2
    only = [p for p in cat.paths if "*" in p]
    assert read_files(spark, only).count() == 1


def test_csv_types_widened_and_headers_by_name(spark, tmp_path):
    d = str(tmp_path / "csv")
    write(f"{d}/1.csv", "a,b\n1,x\n2,y\n")
    write(f"{d}/2.csv", "b,a\nz,3\n")
    df = read_files(spark, find_input_files(spark, d).paths)
    assert dict(df.dtypes)["a"] == "bigint"
    rows = sorted((r.a, r.b) for r in df.collect())
    assert rows == [(1, "x"), (2, "y"), (3, "z")]


def test_csv_quotes_newlines_awkward_names(spark, tmp_path):
    f = write(str(tmp_path / "q.csv"),
              '$email,a.b,with space,x-y\n"a@b.c","say ""hi""","line1\nline2",7\n')
    df = read_files(spark, [f])
    r = df.collect()[0]
    assert df.columns == ["$email", "a.b", "with space", "x-y"]
    assert r["a.b"] == 'say "hi"' and r["with space"] == "line1\nline2"


def test_tsv(spark, tmp_path):
    f = write(str(tmp_path / "t.tsv"), "a\tb\n1\thello, world\n")
    r = read_files(spark, [f]).collect()[0]
    assert r.a == 1 and r.b == "hello, world"


def test_ndjson_malformed_line_counted_and_union_by_name(spark, tmp_path):
    f = write(str(tmp_path / "e.ndjson"),
              '{"z": 1, "b": "x", "n": {"k": [1, 2]}}\n'
              'this is not json\n'
              '{"z": 2, "b": null, "c": "late"}\n')
    df = read_files(spark, [f])
    assert df.count() == 3
    # first-seen key order, not Spark's alphabetical order
    assert df.columns == ["z", "b", "n", "c"]
    rows = df.collect()
    assert sum(1 for r in rows if all(v is None for v in r)) == 1
    assert [r.c for r in rows if r.z == 2] == ["late"]


def test_json_array_file(spark, tmp_path):
    f = write(str(tmp_path / "arr.json"), '[\n {"a": 1}, {"a": 2, "b": "x"}\n]\n')
    df = read_files(spark, [f])
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_json_timestamps_inferred(spark, tmp_path):
    f = write(str(tmp_path / "t.ndjson"), '{"time": "2025-05-17T13:30:29.447Z", "v": 1}\n')
    assert dict(read_files(spark, [f]).dtypes)["time"].startswith("timestamp")


def test_compressed_inputs(spark, tmp_path):
    text = b"a,b\n1,2\n3,4\n"
    paths = []
    for name, data in [("g.csv.gz", gzip.compress(text)), ("b.csv.bz2", bz2.compress(text)),
                       ("z.csv.zst", zstandard.ZstdCompressor().compress(text))]:
        p = str(tmp_path / name)
        with open(p, "wb") as fh:
            fh.write(data)
        paths.append(p)
    for p in paths:
        assert read_files(spark, [p]).count() == 2, p
    xz = str(tmp_path / "x.csv.xz")
    with open(xz, "wb") as fh:
        fh.write(b"\xfd7zXZ\x00")
    with pytest.raises(UnsupportedFormat, match="xz"):
        read_files(spark, [xz])


def test_concatenated_gzip_members(spark, tmp_path):
    p = str(tmp_path / "two.ndjson.gz")
    with open(p, "wb") as fh:
        fh.write(gzip.compress(b'{"a": 1}\n') + gzip.compress(b'{"a": 2}\n'))
    assert read_files(spark, [p]).count() == 2


def test_parquet_gz_inner_codec_ok_outer_refused(spark, tmp_path):
    d = str(tmp_path / "pq")
    spark.range(5).coalesce(1).write.option("compression", "gzip").parquet(d)
    part = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
    inner = str(tmp_path / "inner.parquet.gz")
    os.rename(os.path.join(d, part), inner)
    assert read_files(spark, [inner]).count() == 5
    outer = str(tmp_path / "outer.parquet.gz")
    with open(inner, "rb") as src, open(outer, "wb") as dst:
        dst.write(gzip.compress(src.read()))
    with pytest.raises(UnsupportedFormat, match="not a Parquet file"):
        read_files(spark, [outer])


def test_xml_row_tag_from_root(spark, tmp_path):
    f = write(str(tmp_path / "emp.xml"),
              '<?xml version="1.0"?>\n<employees>\n'
              '  <employee><id>1</id><name>Ann</name><department>Eng</department></employee>\n'
              '  <employee><id>2</id><name>Bo</name><department>Ops</department></employee>\n'
              '</employees>\n')
    df = read_files(spark, [f], ReadOptions(xml_root="employees"))
    assert df.count() == 2 and set(df.columns) == {"id", "name", "department"}
    assert dict(df.dtypes)["id"] == "bigint"


def test_xml_default_root(spark, tmp_path):
    rows = "".join(f"<row><event>e{i}</event><amount>{i}</amount>"
                   f"<time>2025-05-17T13:30:29.447Z</time></row>" for i in range(3))
    f = write(str(tmp_path / "p.xml"), f"<root>{rows}</root>")
    df = read_files(spark, [f])
    assert df.count() == 3 and dict(df.dtypes)["time"].startswith("timestamp")


def test_fast_mode_lines(spark, tmp_path):
    f = write(str(tmp_path / "l.ndjson"), '{"a": 1}\nnot json\n')
    df = read_files(spark, [f], ReadOptions(fast=True))
    assert df.columns == ["line"] and [r.line for r in df.collect()] == ['{"a": 1}', "not json"]


def test_json_date_columns_narrowed_from_sample(spark, tmp_path):
    f = write(str(tmp_path / "d.ndjson"),
              '{"id": 1, "day": "2025-01-02", "ts": "2025-05-17T13:30:29.447Z"}\n'
              '{"id": 2, "day": "2025-02-03", "ts": "2025-05-18"}\n')
    df = read_files(spark, [f])
    types = dict(df.dtypes)
    assert types["day"] == "date" and types["ts"].startswith("timestamp")
    assert df.columns == ["id", "day", "ts"]
    assert [str(r.day) for r in df.orderBy("id").collect()] == ["2025-01-02", "2025-02-03"]


def test_csv_without_multiline_is_splittable_job_option(spark, tmp_path):
    from ferry import Job, run
    f = write(str(tmp_path / "plain.csv"), "a,b\n" + "".join(f"{i},x{i}\n" for i in range(5000)))
    out = str(tmp_path / "o")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        res = run(spark, Job(input=f, format="ndjson", output=out, csv_multiline=False))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import json
    got = [json.loads(x)["a"] for x in open(res.outputs[0].path.replace("file:", ""))]
    assert got == list(range(5000))


def test_given_schema_skips_inference(spark, tmp_path):
    from ferry import Job, run
    f = write(str(tmp_path / "s.csv"), "a,b\n" + "".join(f"{i},x{i}\n" for i in range(200)))
    out = str(tmp_path / "o")
    res = run(spark, Job(input=f, sql="SELECT max(a) AS m FROM input_data", output=out, schema="a string, b string"))
    assert res.result.collect()[0].m == "99"
    bad = write(str(tmp_path / "bad.csv"), "a,b\n1,x\noops,y\n")
    with pytest.raises(Exception):
        run(spark, Job(input=bad, format="ndjson", output=out, schema="a int, b string"))


def test_one_late_time_keeps_the_column_a_timestamp(spark, tmp_path):
    f = write(str(tmp_path / "t.ndjson"), '{"d": "2025-01-02", "e": "2025-01-02"}\n' * 30000
              + '{"d": "2025-01-02T13:30:29.447Z", "e": "2025-01-03"}\n')
    df = read_files(spark, [f])
    assert dict(df.dtypes) == {"d": "timestamp", "e": "date"}
    assert df.selectExpr("max(cast(d as string))").first()[0] == "2025-01-02 13:30:29.447"


def test_header_signature_is_the_whole_header(spark, tmp_path):
    wide = ",".join(f"column_{i:05d}" for i in range(6000))
    a = write(str(tmp_path / "a.csv"), f"{wide},x,y\n" + "0," * 6000 + "1,2\n")
    b = write(str(tmp_path / "b.csv"), f"{wide},y,x\n" + "0," * 6000 + "2,1\n")
    rows = read_files(spark, [a, b]).select("x", "y").collect()
    assert [(r.x, r.y) for r in rows] == [(1, 2), (1, 2)]


def test_header_with_a_quoted_newline(spark, tmp_path):
    a = write(str(tmp_path / "a.csv"), '"k\nA",v\n1,2\n')
    b = write(str(tmp_path / "b.csv"), '"k\nB",v\n3,4\n')
    df = read_files(spark, [a, b])
    assert set(df.columns) == {"k\nA", "v", "k\nB"}
    assert sorted((r["k\nA"], r["k\nB"], r["v"]) for r in df.collect() if r["v"] == 4) == [(None, 3, 4)]


def test_xml_row_tags_of_every_file_and_child(spark, tmp_path):
    a = write(str(tmp_path / "a.xml"), "<root><meta/><row><x>1</x></row><row><x>2</x></row></root>")
    b = write(str(tmp_path / "b.xml"), "<root><item><x>3</x><y>4</y></item></root>")
    rows = read_files(spark, [a, b]).collect()
    assert sorted(r.x for r in rows if r.x is not None) == [1, 2, 3]


def test_tsv_of_unequal_width_is_refused(spark, tmp_path):
    a = write(str(tmp_path / "a.tsv"), "a\tb\n1\t2\n")
    b = write(str(tmp_path / "b.tsv"), "x\ty\n3\t4\n")
    c = write(str(tmp_path / "c.tsv"), "x\ty\tz\n3\t4\t5\n")
    assert sorted(tuple(r) for r in read_files(spark, [a, b]).collect()) == [(1, 2), (3, 4)]
    with pytest.raises(UnsupportedFormat):
        read_files(spark, [a, c])


def test_parquet_of_unequal_schema_merges_by_name(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 2 AS b").coalesce(1).write.parquet(str(tmp_path / "p1"))
    spark.sql("SELECT 3 AS a, 4 AS c").coalesce(1).write.parquet(str(tmp_path / "p2"))
    import glob
    files = sorted(glob.glob(str(tmp_path / "p*/part-*.parquet")))
    rows = read_files(spark, files).select("a", "b", "c").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 2, None), (3, None, 4)]

def test_local_glob_input(spark, tmp_path):
    from ferry import Job, run
    d = tmp_path / "g"
    write(str(d / "a.csv"), "x\n1\n")
    write(str(d / "b.csv"), "x\n2\n")
    write(str(d / "c.tsv"), "x\n3\n")
    cat = find_input_files(spark, str(d / "*.csv"))
    assert [p.rsplit("/", 1)[1] for p in cat.paths] == ["a.csv", "b.csv"]
    out = str(tmp_path / "o")
    res = run(spark, Job(input=str(d / "*.csv"), format="ndjson", single_file=True,
                         output=out + "/all.ndjson"))
    assert open(res.outputs[0].path.replace("file:", "")).read().splitlines() == \
        ['{"x":1}', '{"x":2}']


def test_several_compressed_csv_files_probe_headers(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    for name, comp in [("a.csv.zst", zstandard.ZstdCompressor().compress),
                       ("b.csv.gz", gzip.compress), ("c.csv.bz2", bz2.compress)]:
        with open(d / name, "wb") as fh:
            fh.write(comp(b"x,y\n1,2\n"))
    rows = read_files(spark, find_input_files(spark, str(d)).paths).collect()
    assert [(r.x, r.y) for r in rows] == [(1, 2)] * 3


def test_key_order_of_many_lines_takes_no_sort(spark, tmp_path, monkeypatch):
    """The lines are aggregated by hashing; a sort of a whole file in one task took its memory."""
    from ferry.sources import readers
    path = str(tmp_path / "a.ndjson")
    with open(path, "w") as f:
        f.write('{"b": 1, "t": "2024-01-01"}\n{"c": 2, "b": 1, "t": "2024-01-02"}\n{"a": "2024-01-01 10:00:00"}\n')
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    plans, collect = [], Classic.collect

    def spy(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(Classic, "collect", spy)
    assert readers.json_facts(spark, [path], ["t", "a"]) == (["b", "t", "c", "a"], ["t"])
    assert plans
    # the aggregate next to the scan
    first = [line for line in plans[-1].splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in first, plans[-1]

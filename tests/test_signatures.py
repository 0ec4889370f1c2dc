"""Files looked at by tasks give the same answers as files looked at from the driver."""
import bz2
import gzip
import os

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard

from ferry import Job, run
from ferry.sources import probe
from ferry.sources.readers import ReadOptions, schema_groups


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_headers_and_first_characters(spark, tmp_path, monkeypatch):
    long = b'"' + b"n\n" * 9000 + b'",k\n1,2\n'
    bodies = {"a.csv": b"k,v\n1,2\n", "b.csv": "\ufeffk,v\r\n1,2\r\n".encode(), "c.csv": long, "d.csv": b"only",
              "e.csv.gz": gzip.compress(b"x,y\n1,2\n"), "f.csv.bz2": bz2.compress(b"x,z\n"),
              "g.csv.zst": zstandard.compress(long), "sp ace%20[1].csv": b"k,v\n"}
    paths = [put(f"{tmp_path}/{n}", b) for n, b in bodies.items()]
    want = probe.header_records(spark, paths)
    chars = [put(f"{tmp_path}/{n}.json", b) for n, b in {"p": b"  \n" * 5000 + b"[1]", "q": b"{}", "r": b" \n "}.items()]
    first = probe.first_chars(spark, chars)
    monkeypatch.setattr(probe, "DRIVER_FILES", 0)
    assert probe.header_records(spark, paths) == want and want[paths[2]] == '"' + "n\n" * 9000 + '",k'
    assert probe.first_chars(spark, chars) == first and list(first.values()) == ["[", "{", ""]


def test_parquet_groups(spark, tmp_path, monkeypatch):
    tables = [pa.table({"k": [1]}), pa.table({"k": ["x"]}), pa.table({"k": [2]}), pa.table({"k": [1], "v": [1.5]})]
    paths = []
    for i, t in enumerate(tables):
        paths.append(f"{tmp_path}/{i}.parquet")
        pq.write_table(t, paths[-1])
    want = schema_groups(spark, paths, ReadOptions())
    monkeypatch.setattr(probe, "DRIVER_FILES", 0)
    assert schema_groups(spark, paths, ReadOptions()) == want == [[paths[0], paths[2]], [paths[1]], [paths[3]]]


def test_many_files_take_one_job_for_their_headers(spark, tmp_path, monkeypatch):
    src = f"{tmp_path}/in"
    for i in range(150):
        put(f"{src}/f{i:03d}.csv", b"k,v\n1,2\n" if i % 3 else b"v,w\nx,y\n")
    seen = []
    until = probe._until
    monkeypatch.setattr(probe, "_until", lambda *a: seen.append(a[1]) or until(*a))
    res = run(spark, Job(input=src, format="ndjson", output=f"{tmp_path}/out"))
    assert len(res.outputs) == 150 and not seen         # no file was opened by the driver
    assert open(f"{tmp_path}/out/f000.ndjson").read() == '{"v":"x","w":"y"}\n'
    assert open(f"{tmp_path}/out/f001.ndjson").read() == '{"k":1,"v":2}\n'

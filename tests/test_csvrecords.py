"""CSV read in splits: the same rows as the plain reader's, however the file is cut."""
import csv
import io
import os
import random

import pytest

from ferry import Job, run
from ferry.functions.internal import SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.sinks import layout
from ferry.sources import csvrecords
from ferry.sources.readers import ReadOptions, read_files

CONF = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", layout.ASSEMBLE_MIN_BYTES_CONF)


@pytest.fixture
def cut(spark):
    def at(size):
        for k, v in zip(CONF, (str(size), "1", "0")):
            spark.conf.set(k, v)
    yield at
    for k in CONF:
        spark.conf.unset(k)


def text(rows, header, end="\n", sep=","):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end, delimiter=sep)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def put(path, body):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(body)
    return path


def sample(n, seed):
    r = random.Random(seed)
    bits = ["a", '"', "\n", ",", "é", " ", "\r\n", "\t", "1", "\n\n"]
    return [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 50))), r.choice(["x", "", "y z"])) for i in range(n)]


@pytest.mark.parametrize("size", [200, 4000])
def test_any_cut_gives_the_rows_in_order(spark, tmp_path, cut, size):
    files = {}
    for k, end in enumerate(["\n", "\r\n"]):
        rows = sample(120, k)
        body = text(rows, ["id", 'te"x\nt', "z"], end)
        files[put(f"{tmp_path}/{k}.csv", body.rstrip("\n") if k == 0 else body)] = rows
    cut(size)
    df = read_files(spark, list(files), ReadOptions(csv_one_header=True), tag=True)
    assert df.dtypes[:3] == [("id", "bigint"), ('te"x\nt', "string"), ("z", "string")]
    got = [tuple(r)[:3] for r in df.orderBy(SRC_FILE, SRC_BLOCK, SRC_POS).collect()]
    assert got == [(i, t or None, z or None) for rows in files.values() for i, t, z in rows]
    places = df.groupBy(SRC_FILE, SRC_BLOCK).count().count()
    assert df.groupBy(SRC_FILE, SRC_BLOCK).agg({SRC_POS: "max", "*": "count"}).where(
        f"`max({SRC_POS})` + 1 <> `count(1)`").count() == 0 and places > 4


def test_both_readers_agree(spark, tmp_path, cut):
    body = "﻿k,v,w\n\n1,x,2020-01-02\n2,,\n\n3,\"a\n\nb\",2020-01-03\n4,\"say \"\"hi\"\"\"\n" * 1 + "5,  pad ,2020-01-04\n"
    plain = put(f"{tmp_path}/p.csv", body)
    want = read_files(spark, [plain])
    cut(16)
    got = read_files(spark, [plain])
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.count() == 5


def test_a_header_longer_than_a_split(spark, tmp_path, cut):
    src = put(f"{tmp_path}/h.csv", text([(i, "x") for i in range(20)], ["k", "long\n" * 60]))
    cut(64)
    df = read_files(spark, [src])
    assert df.columns == ["k", "long\n" * 60] and df.count() == 20


def test_a_row_like_the_header_is_a_row(spark, tmp_path, cut):
    src = put(f"{tmp_path}/h.csv", "k,v\n1,2\nk,v\n3,4\n" + "5,6\n" * 40)
    want = sorted(read_files(spark, [src]).collect())
    cut(20)
    assert sorted(read_files(spark, [src]).collect()) == want and len(want) == 43


def test_chunks_per_file_outputs_and_merges(spark, tmp_path, cut):
    rows = sample(500, 5)
    src = put(f"{tmp_path}/in/a.csv", text(rows, ["id", "t", "z"]))
    put(f"{tmp_path}/in/b.csv", text(rows[:7], ["id", "t", "z"]))
    cut(1500)
    want = [i for i, *_ in rows]
    res = run(spark, Job(input=src, format="csv", rows=100, output=f"{tmp_path}/chunks"))
    chunks = [list(csv.DictReader(open(w.path.replace("file:", ""), newline=""))) for w in sorted(res.outputs, key=lambda w: w.chunk)]
    assert [len(c) for c in chunks] == [100] * 5 and [int(r["id"]) for c in chunks for r in c] == want
    assert [r["t"] for c in chunks for r in c] == [t for _, t, _ in rows]
    whole = run(spark, Job(input=f"{tmp_path}/in", format="csv", output=f"{tmp_path}/whole")).outputs
    assert len(whole) == 2
    for w, own in zip(sorted(whole, key=lambda w: w.path), (rows, rows[:7])):
        back = list(csv.DictReader(open(w.path.replace("file:", ""), newline="")))
        assert [(int(r["id"]), r["t"]) for r in back] == [(i, t) for i, t, _ in own]
    one = run(spark, Job(input=f"{tmp_path}/in", format="csv", single_file=True, output=f"{tmp_path}/m/all.csv")).outputs[0]
    assert [int(r["id"]) for r in csv.DictReader(open(one.path.replace("file:", ""), newline=""))] == want + want[:7]


def test_many_boundaries_inside_quotes_are_joined(spark, tmp_path, cut, monkeypatch):
    monkeypatch.setattr(csvrecords, "MAX_BROADCAST_SPLITS", 0)
    rows = sample(100, 9)
    src = put(f"{tmp_path}/a.csv", text(rows, ["id", "t", "z"]))
    cut(300)
    df = read_files(spark, [src], tag=True)
    got = [tuple(r)[:2] for r in df.orderBy(SRC_FILE, SRC_BLOCK, SRC_POS).collect()]
    assert got == [(i, t or None) for i, t, _ in rows]


@pytest.mark.parametrize("size", [1 << 20, 16])
@pytest.mark.parametrize("name", ["r.csv", "r[1].csv"])
def test_extra_cells_fail_and_missing_ones_are_null(spark, tmp_path, cut, size, name):
    short = put(f"{tmp_path}/s/{name}", 'k,v\n1,2\n3\n"4,\n5","x,y"\n')
    long = put(f"{tmp_path}/l/{name}", "k,v\n1,2\n3,4,,5\n")
    cut(size)
    assert sorted(map(tuple, read_files(spark, [short]).collect()), key=str) == [("1", "2"), ("3", None), ("4,\n5", "x,y")]
    with pytest.raises(Exception, match="more cells than its header"):
        read_files(spark, [long]).collect()
    with pytest.raises(Exception, match="more cells than its header"):
        run(spark, Job(input=long, format="ndjson", cols="k", output=f"{tmp_path}/out"))
    assert read_files(spark, [short]).count() == 3


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_a_given_schema(spark, tmp_path, cut, size):
    src = put(f"{tmp_path}/a.csv", 'k,v\n1,"2\n3"\n4,5\n')
    cut(size)
    df = read_files(spark, [src], ReadOptions(schema="k string, v string"))
    assert sorted(map(tuple, df.collect())) == [("1", "2\n3"), ("4", "5")]
    with pytest.raises(Exception):
        read_files(spark, [src], ReadOptions(schema="k bigint, v bigint")).collect()


@pytest.mark.parametrize("size", [1 << 20, 8])
def test_types_do_not_depend_on_neighbours(spark, tmp_path, cut, size):
    d = f"{tmp_path}/in"
    for name, values in {"a": "1\n2\n", "b": "x\n", "c": "1.5\n2\n", "d": "true\n", "e": "2020-01-01\n", "f": "3\n"}.items():
        put(f"{d}/{name}.csv", "k\n" + values)
    cut(size)
    run(spark, Job(input=d, format="ndjson", output=f"{tmp_path}/out"))
    got = {n: open(f"{tmp_path}/out/{n}.ndjson").read().split()[0] for n in "abcdef"}
    assert got == {"a": '{"k":1}', "b": '{"k":"x"}', "c": '{"k":1.5}', "d": '{"k":true}', "e": '{"k":"2020-01-01"}', "f": '{"k":3}'}


def test_files_of_length_zero_get_outputs(spark, tmp_path):
    d = f"{tmp_path}/in"
    put(f"{d}/a.csv", "k\n1\n"), put(f"{d}/b.csv", ""), put(f"{d}/sub/c.csv", "")
    res = run(spark, Job(input=d, format="ndjson", output=f"{tmp_path}/out"))
    assert sorted(os.path.basename(w.path) for w in res.outputs) == ["a.ndjson", "b.ndjson", "c.ndjson"]
    assert open(f"{tmp_path}/out/b.ndjson").read() == "" and open(f"{tmp_path}/out/a.ndjson").read() == '{"k":1}\n'
    res = run(spark, Job(input=f"{d}/b.csv", format="xml", output=f"{tmp_path}/x"))
    assert [os.path.basename(w.path) for w in res.outputs] == ["b.xml"]
    with pytest.raises(ValueError, match="empty"):
        run(spark, Job(input=f"{d}/b.csv", format="csv", single_file=True, output=f"{tmp_path}/m.csv"))


def test_a_quote_in_a_json_name(spark, tmp_path):
    src = put(f"{tmp_path}/q.ndjson", '{"it\'s":"2020-01-01","its":"x"}\n')
    assert dict(read_files(spark, [src]).dtypes) == {"it's": "date", "its": "string"}


def test_workers_get_batches_bounded_in_bytes(spark):
    """Long lines: 10,000 rows to a batch would be 40 MB."""
    from pyspark.sql import functions as F

    from ferry.session import BATCH_BYTES, job_session

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = job_session(spark).range(10_000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 40_000_000 and max(found) < 2 * BATCH_BYTES

"""Batched HTTP delivery with injected transports (no sockets)."""

import json
import os

import pytest

from ferry import Job, run
from ferry.functions.internal import SOURCE_COLS
from ferry.sources.readers import read_files
from ferry.streaming.delivery import (DeliveryConfig, deliver, header_dict, next_wait,
                                      post_chunk, throughput)

from tests.conftest import SF001


class Seq:
    """Answers from a list of status codes per attempt (or raises OSError for 0)."""

    def __init__(self, codes):
        self.codes = codes
        self.seen = []

    def __call__(self, req):
        self.seen.append(req)
        code = self.codes[min(req.attempt, len(self.codes)) - 1]
        if code == 0:
            raise OSError("connection refused")
        return code, "body"


def sent(codes):
    waits = []
    t = Seq(codes)
    recs = post_chunk(["{}", "{}"], 3, DeliveryConfig(url="http://x", rate_delay=0.0), t,
                      sleep=waits.append)
    return recs, [w for w in waits if w], t


@pytest.mark.parametrize("codes,expected_codes,outcome,waits", [
    ([200], [200], "delivered", []),
    ([429, 200], [429, 200], "delivered", [2.0]),
    ([500, 500, 500], [500, 500, 500], "failed", [1.0, 2.0]),
    ([404], [404], "failed", []),
    ([0, 0, 200], [0, 0, 200], "delivered", [1.0, 2.0]),
    ([302, 302, 302], [302, 302, 302], "failed", [1.0, 2.0]),
])
def test_retry_policy(codes, expected_codes, outcome, waits):
    recs, got_waits, _ = sent(codes)
    assert [r["http_code"] for r in recs] == expected_codes
    assert recs[-1]["outcome"] == outcome
    assert got_waits == waits
    assert all(r["n_rows"] == 2 and r["file"] == "chunk-4" for r in recs)


def test_headers_and_body():
    recs, _, t = sent([200])
    req = t.seen[0]
    assert req.headers["Content-Type"] == "application/json"
    assert req.headers["Idempotency-Key"].endswith("-chunk-3")
    assert req.body == b"{}\n{}\n"
    assert header_dict(["content-type: text/plain", "Authorization: Bearer t"]) == \
        {"content-type": "text/plain", "Authorization": "Bearer t"}
    with pytest.raises(ValueError):
        header_dict(["no colon"])
    assert next_wait(201, 1, 1.0) is None and next_wait(429, 2, 1.0) == 4.0


class ByChunk:
    def __call__(self, req):
        return (500 if req.chunk == 1 else 200), "ok"


def _no_sleep(_):
    return None


def test_deliver_in_chunks_from_executors(spark):
    df = read_files(spark, [f"{SF001}/events.parquet"], tag=True)
    log = deliver(df, DeliveryConfig(url="http://x", rows=300), transport=ByChunk(),
                  sleep=_no_sleep)
    rows = log.collect()
    chunks = {r.chunk for r in rows}
    assert chunks == {0, 1, 2, 3}
    assert sorted(r.n_rows for r in rows if r.attempt == 1) == [100, 300, 300, 300]
    assert [r.http_code for r in rows if r.chunk == 1] == [500, 500, 500]
    tp = throughput(log).collect()[0]
    assert tp.requests == 3 and tp.records == 700


class Capture:
    """Records bodies into files (a stand-in receiver), keyed by idempotency key."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, req):
        name = req.headers["Idempotency-Key"].rsplit("-", 2)
        with open(os.path.join(self.folder, f"{name[-2]}-{name[-1]}.ndjson"), "wb") as fh:
            fh.write(req.body)
        return 200, "ok"


def test_job_with_url_posts_every_row_once_and_writes_log(spark, tmp_path):
    recv = tmp_path / "recv"
    recv.mkdir()
    out = str(tmp_path / "o")
    res = run(spark, Job(input=f"{SF001}/orders.parquet", format="ndjson", url="http://x",
                         rows=400, output=out, log=True),
              transport=Capture(str(recv)), sleep=_no_sleep)
    bodies = sorted(os.listdir(recv))
    assert len(bodies) == 4  # 1500 orders / 400
    keys = []
    for b in bodies:
        keys += [json.loads(x)["o_orderkey"] for x in open(recv / b).read().splitlines()]
    assert len(keys) == len(set(keys)) == 1500
    log = [json.loads(x) for x in open(os.path.join(out, "response-logs.json")).read().splitlines()]
    assert len(log) == 4 and {r["http_code"] for r in log} == {200}
    assert len([w for w in res.outputs]) == 4


class Counting:
    def __init__(self, folder):
        self.folder = folder

    def __call__(self, req):
        import uuid
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return 200, "ok"


def test_reading_the_log_never_resends(spark, tmp_path):
    sent_dir = tmp_path / "sent"
    sent_dir.mkdir()
    res = run(spark, Job(input=f"{SF001}/orders.parquet", format="ndjson", url="http://x",
                         rows=500, output=str(tmp_path / "o")),
              transport=Counting(str(sent_dir)), sleep=_no_sleep)
    assert len(os.listdir(sent_dir)) == 3
    res.delivery_log.collect()
    res.delivery_log.count()
    assert len(os.listdir(sent_dir)) == 3


def test_sql_per_file_chunks_with_awkward_names(spark, tmp_path):
    src = tmp_path / "in dir"
    src.mkdir()
    with open(src / "my file.csv", "w") as fh:
        fh.write("a\n" + "".join(f"{i}\n" for i in range(25)))
    out = str(tmp_path / "o")
    res = run(spark, Job(input=str(src / "my file.csv"), format="csv", rows=10, output=out,
                         sql="SELECT a FROM input_data WHERE a >= 5 ORDER BY a"))
    names = sorted(os.path.basename(w.path) for w in res.outputs)
    assert names == ["my file-1.csv", "my file-2.csv"]


class Bodies:
    """Stores each chunk's body under its chunk number (a stand-in receiver)."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, req):
        path = os.path.join(self.folder, f"{req.chunk}.ndjson")
        assert not os.path.exists(path), f"chunk {req.chunk} sent twice"
        with open(path, "wb") as fh:
            fh.write(req.body)
        return 200, "ok"


def test_chunks_sent_in_place_or_gathered_each_once_in_order(spark, tmp_path):
    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"seq": {i}, "pad": "{"q" * 40}"}}\n')
    recv = tmp_path / "recv"
    recv.mkdir()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_files(spark, [f], tag=True)
        log = deliver(df, DeliveryConfig(url="http://x", rows=250, rate_delay=0.0),
                      transport=Bodies(str(recv)), sleep=_no_sleep)
        plan = log._jdf.queryExecution().executedPlan().toString()
        rows = log.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" in plan
    assert len(rows) == 80 and {r.chunk for r in rows} == set(range(80))
    for c in range(80):
        seqs = [json.loads(x)["seq"] for x in open(recv / f"{c}.ndjson").read().splitlines()]
        assert seqs == list(range(c * 250, (c + 1) * 250))


def test_keys_differ_by_source_path():
    from ferry.streaming.delivery import idempotency_key
    cfg = DeliveryConfig(url="http://x", job_id="j")
    assert idempotency_key(cfg, 0, "/a/x.csv") != idempotency_key(cfg, 0, "/b/x.csv")
    assert idempotency_key(cfg, 0, "/a/x.csv") == idempotency_key(cfg, 0, "/a/x.csv")


def test_protocol_errors_are_retried_like_network_errors():
    import http.client

    class Broken:
        def __call__(self, req):
            raise http.client.RemoteDisconnected("closed") if req.attempt == 1 else http.client.BadStatusLine("x")

    recs = post_chunk(["{}"], 0, DeliveryConfig(url="http://x", rate_delay=0.0), Broken(), sleep=lambda s: None)
    assert [r["http_code"] for r in recs] == [0, 0, 0] and recs[-1]["outcome"] == "failed"


def test_one_cap_over_all_sending_tasks(spark):
    df = read_files(spark, [f"{SF001}/events.parquet"], tag=True).repartition(6)
    log = deliver(df.drop(*SOURCE_COLS), DeliveryConfig(url="http://x", rows=50, rate_delay=0.0),
                  transport=Seq([200]), sleep=lambda s: None, max_concurrency=2)
    assert log.rdd.getNumPartitions() <= 2
    assert log.agg({"n_rows": "sum"}).first()[0] == 1000


def test_merged_output_is_posted_whole(spark, tmp_path):
    from tests.conftest import write
    for n in "ab":
        write(str(tmp_path / "in" / f"{n}.ndjson"), f'{{"k": "{n}"}}\n')
    seen = str(tmp_path / "seen")

    class Keep:
        def __call__(self, req):
            with open(seen, "ab") as f:
                f.write(req.body)
            return 200, "ok"

    res = run(spark, Job(input=str(tmp_path / "in"), format="ndjson", single_file=True, url="http://x",
                         output=str(tmp_path / "out" / "all.ndjson")), transport=Keep(), sleep=lambda s: None)
    assert open(seen).read() == '{"k":"a"}\n{"k":"b"}\n'
    assert [(r.http_code, r.n_rows, r.file) for r in res.delivery_log.collect()] == [(200, 2, "all.ndjson")]

"""A merged file is posted in blocks; columns of any name are delivered."""
import http.client
import socket
import threading

import pytest
from pyspark.sql import functions as F

from ferry.streaming import delivery
from ferry.streaming.delivery import BLOCK, DeliveryConfig, FileBody, HttpTransport, Request, deliver, deliver_file


class Counting:
    """Answers with the number of bytes and the largest block, failing once."""

    def __call__(self, req):
        sizes = [len(b) for b in req.blocks()]
        assert sum(sizes) == len(req.content)
        return (500 if req.attempt == 1 else 200), f"{sum(sizes)},{max(sizes)},{isinstance(req.content, FileBody)}"


def test_a_large_file_goes_in_blocks_and_again_on_a_retry(spark, tmp_path):
    path = tmp_path / "all.ndjson"
    line = b'{"k": "' + b"x" * 1000 + b'"}\n'
    with open(path, "wb") as f:
        for _ in range(20):
            f.write(line * 1000)
    log = deliver_file(spark, str(path), DeliveryConfig(url="http://x", rate_delay=0.0), Counting(), sleep=lambda s: None).collect()
    n = 20000 * len(line)
    assert [(r.http_code, r.response, r.n_rows) for r in log] == [(500, f"{n},{BLOCK},True", 20000), (200, f"{n},{BLOCK},True", 20000)]


def test_memory_stays_at_a_block(tmp_path):
    import tracemalloc
    path = tmp_path / "big"
    with open(path, "wb") as f:
        for _ in range(300):
            f.write(b"y" * (1 << 20))
    body = FileBody(str(path), 300 << 20, {})
    tracemalloc.start()
    assert sum(map(len, Request("http://x", body, {}, 0, 1).blocks())) == 300 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_the_transport_sends_blocks_under_one_length(monkeypatch, tmp_path):
    """Both ends of a socket pair: what the HTTP client writes, without a server."""
    path = tmp_path / "body"
    path.write_bytes(b"z" * (3 * BLOCK + 5))
    near, far = socket.socketpair()
    got = bytearray()

    def answer():
        while b"\r\n\r\n" not in got or len(got) < got.index(b"\r\n\r\n") + 4 + 3 * BLOCK + 5:
            got.extend(far.recv(1 << 16))
        far.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok")

    monkeypatch.setattr(http.client.HTTPConnection, "connect", lambda self: setattr(self, "sock", near))
    peer = threading.Thread(target=answer)
    peer.start()
    status, text = HttpTransport()(Request("http://collector.invalid/x", FileBody(str(path), 3 * BLOCK + 5, {}), {"A": "b"}, 0, 1))
    peer.join(10)
    head, body = bytes(got).split(b"\r\n\r\n", 1)
    assert (status, text) == (200, "ok") and body == b"z" * (3 * BLOCK + 5)
    assert b"Content-Length: %d" % (3 * BLOCK + 5) in head and b"chunked" not in head.lower()


def test_columns_named_like_the_logs_own(spark):
    df = spark.range(5).select(F.col("id").alias("source"), F.lit(1).alias("chunk"), F.lit(2).alias("idx"),
                               F.lit(3).alias("_whole"), F.lit("l").alias("line"))
    seen = deliver(df, DeliveryConfig(url="http://x", rows=2, rate_delay=0.0), Echo(), sleep=lambda s: None).collect()
    assert sum(r.n_rows for r in seen) == 5 and all('"_whole":3,"line":"l"' in r.response for r in seen)


class Echo:
    def __call__(self, req):
        return 200, req.body.decode()


def test_bytes_are_one_block():
    assert list(Request("u", b"abc", {}, 0, 1).blocks()) == [b"abc"] and delivery.BLOCK == 1 << 20
    with pytest.raises(FileNotFoundError):
        list(FileBody("/no/such/file", 1, {}).blocks())

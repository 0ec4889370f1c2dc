import base64
import hashlib

import pytest

from ferry.llm import warc
from ferry.session import scratch_path

SCHEMA = "page_id long, url string, html string, record string, `file` string"


def expected(rows):
    best = {}
    for pid, _, html in rows:
        if pid is not None:
            best[html or ""] = max(best.get(html or "", pid), pid)
    out = []
    for pid, _, html in rows:
        body = (html or "").encode()
        refers = best.get(html or "")
        out.append((pid, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if refers == pid or refers is None else "revisit",
                    None if refers == pid else refers))
    return sorted(out, key=repr)


def roundtrip(spark, rows, parts=3, split=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    path = warc.write_archives(df, scratch_path(spark, "warc-test"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return sorted((tuple(r) for r in got), key=repr), path


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def rows_with_everything():
    rows = [(1, "http://a/é b", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"),
            (5, "u", "x" + FAKE + "y" + FAKE), (6, "u", "WARC/1.1\r\n"), (7, "u", "WARC/1.1WARC/1.1\r\nWARC/1."),
            (8, "u", FAKE), (None, "u", "nobody"), (9, "u", "line\r\n\r\nline\n" * 3000),
            (10, "u", FAKE * 400), (11, "u", "\r\n\r\n"), (12, "u", "x" + FAKE + "y" + FAKE)]
    return rows + [(20 + i, "u", f"page {i} " * (i % 50)) for i in range(200)]


@pytest.mark.parametrize("split", [None, "700b", "4k"])
def test_round_trip(spark, split):
    rows = rows_with_everything()
    got, _ = roundtrip(spark, rows, split=split)
    assert got == expected(rows)


def test_empty_table(spark):
    got, _ = roundtrip(spark, [])
    assert got == []


def test_cut_off_archive_is_refused(spark, tmp_path):
    _, path = roundtrip(spark, [(1, "u", "abc" * 100), (2, "u", "d")], parts=1)
    folder = path.removeprefix("file:")
    import glob
    part = glob.glob(folder.replace("//", "/") + "/part-*")[0]
    data = open(part, "rb").read()
    broken = tmp_path / "broken.warc"
    broken.write_bytes(data[:len(data) // 2])
    with pytest.raises(ValueError):
        warc.read_archives(spark, str(broken)).collect()

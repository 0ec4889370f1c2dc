"""XML looked through piece by piece and read in splits."""

import io
import tracemalloc

import pytest
from pyspark.sql import functions as F

from ferry.functions.internal import SRC_BLOCK, SRC_POS
from ferry.session import conf_bytes, job_session
from ferry.sources import probe, readers
from ferry.sources.readers import read_files
from ferry.sources.splits import split_bytes

from tests.conftest import write


def _small_splits(spark):
    js = job_session(spark)
    js.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    js.conf.set("spark.sql.files.openCostInBytes", "64")
    return js


def _rows(n, more=""):
    return "".join(f'<row id="{i}">\n  <a>{i}</a><b> é &lt;row&gt; {"x" * (i % 90)}</b>{more}\n</row>\n' for i in range(n))


def test_scan_memory_does_not_grow_with_the_file():
    # the scan used to hold the whole file and an element per row
    text = f"<root>{'<row><a>1</a></row>' * 400_000}</root>".encode()

    class Pieces(io.RawIOBase):
        at = 0

        def read(self, n=-1):
            self.at += n
            return text[self.at - n:self.at]

    tracemalloc.start()
    try:
        found = probe.xml_children(Pieces(), "root")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == {"tags": {"row": ["a"]}, "plain": True}
    assert peak < 8 << 20


@pytest.mark.parametrize("body,plain", [
    ("<row><a>1</a></row>", True), ("<row><a/></row>", True), ("<row/><row><a>1</a></row>", False),
    ("<row><a>1</a></row >", False), ("<row><a><![CDATA[</row>]]></a></row>", False),
    ("<!-- </row> --><row><a>1</a></row>", False), ("<?p </row>?><row><a>1</a></row>", False)])
def test_which_files_may_be_cut_at_end_tags(body, plain):
    found = probe.xml_children(io.BytesIO(f"<root>{body}</root>".encode()), "root", piece=3)
    assert found["tags"] == {"row": ["a"]}
    assert found["plain"] == plain


def test_named_root_below_the_top():
    text = b"<top><head><v>1</v></head><root><row i='1'><a>1</a></row></root></top>"
    assert probe.xml_children(io.BytesIO(text), "root")["tags"] == {"row": ["_i", "a"]}
    assert list(probe.xml_children(io.BytesIO(text), "other")["tags"]) == ["head", "root"]
    with pytest.raises(SyntaxError):
        probe.xml_children(io.BytesIO(b"<root><row></root>"), "root")
    with pytest.raises(ValueError):
        probe.xml_children(io.BytesIO(b"<root><row><b><row/></b></row></root>"), "root")


@pytest.mark.parametrize("more", ["", "<c><d>1.5</d></c><c/>"])
def test_rows_of_splits_are_those_of_the_whole_file(spark, tmp_path, more):
    path = write(str(tmp_path / "a.xml"), f'<?xml version="1.0"?>\n<root>\n{_rows(500, more)}</root>')
    whole = read_files(job_session(spark), [path])
    js = _small_splits(spark)
    split = read_files(js, [path], tag=True)
    assert split.select(F.countDistinct(SRC_BLOCK)).first()[0] > 3
    assert [r._id for r in split.orderBy(SRC_BLOCK, SRC_POS).select("_id").collect()] == list(range(500))
    split = read_files(js, [path])
    assert split.schema == whole.schema
    assert split.orderBy("_id").collect() == whole.orderBy("_id").collect()


def test_split_sizes_written_with_a_unit(spark, tmp_path):
    # "16m" used to stop the read: invalid literal for int()
    for tag in ("row", "item"):
        write(str(tmp_path / f"{tag}.xml"), f"<root>{_rows(300).replace('row', tag)}</root>")
    js = _small_splits(spark)
    js.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    js.conf.set("spark.sql.files.openCostInBytes", "64b")
    assert split_bytes(js, [1 << 20]) == 4096
    back = read_files(js, [str(tmp_path / "row.xml"), str(tmp_path / "item.xml")], tag=True)
    assert back.select(F.countDistinct(SRC_BLOCK)).first()[0] > 3
    assert sorted(r._id for r in back.select("_id").collect()) == sorted([*range(300)] * 2)


@pytest.mark.parametrize("text,size", [("4096", 4096), ("4096b", 4096), ("16m", 16 << 20), ("1G", 1 << 30), ("-1", -1)])
def test_sizes_of_settings(spark, text, size):
    js = job_session(spark)
    js.conf.set("spark.ferry.test", text)
    assert conf_bytes(js, "spark.ferry.test", 7) == size
    assert conf_bytes(js, "spark.ferry.unset", 7) == 7


def test_odd_file_longer_than_a_split_is_read_whole(spark, tmp_path):
    path = write(str(tmp_path / "a.xml"), f"<root><!-- <row> -->{_rows(300)}</root>")
    assert read_files(_small_splits(spark), [path]).count() == 300


def test_large_files_are_looked_through_by_tasks(spark, tmp_path, monkeypatch):
    # a file above the limit used to fail the job
    path = write(str(tmp_path / "a.xml"), f"<root>{_rows(50)}</root>")
    monkeypatch.setattr(readers, "XML_SCAN_BYTES", 100)
    assert read_files(spark, [path]).count() == 50

"""The concat path of assembly, against a fake file system (no HDFS here)."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from ferry.sinks.assemble import _try_fs_concat


class FakeFS:
    def __init__(self, files, concat_ok=True):
        self.files = dict(files)
        self.concat_ok = concat_ok
        self.calls = []

    def rename(self, src, dst):
        self.calls.append(("rename", src, dst))
        self.files[dst] = self.files.pop(src)

    def exists(self, p):
        return p in self.files

    def delete(self, p, recursive=False):
        self.files.pop(p, None)

    def copy_file(self, src, dst):
        self.files[dst] = self.files[src]

    def concat(self, target, sources):
        if not self.concat_ok:
            raise RuntimeError("concat not supported")
        assert all(s.rsplit("/", 1)[0] == target.rsplit("/", 1)[0] for s in sources)
        self.files[target] += b"".join(self.files.pop(s) for s in sources)


def test_concat_moves_parts_next_to_target_then_joins():
    fs = FakeFS({"hdfs://n/stage/p0": b"A", "hdfs://n/stage/p1": b"B", "hdfs://n/stage/p2": b"C"})
    assert _try_fs_concat(fs, "hdfs://n/out/x.csv", None,
                          ["hdfs://n/stage/p0", "hdfs://n/stage/p1", "hdfs://n/stage/p2"])
    assert fs.files == {"hdfs://n/out/x.csv": b"ABC"}


def test_concat_with_shared_header_prefix():
    fs = FakeFS({"hdfs://n/stage/h": b"H", "hdfs://n/stage/p0": b"A", "hdfs://n/stage/p1": b"B"})
    assert _try_fs_concat(fs, "hdfs://n/out/x.csv", "hdfs://n/stage/h",
                          ["hdfs://n/stage/p0", "hdfs://n/stage/p1"])
    assert fs.files["hdfs://n/out/x.csv"] == b"HAB" and "hdfs://n/stage/h" in fs.files


def test_failed_concat_restores_parts_for_the_copy():
    before = {"hdfs://n/stage/p0": b"A", "hdfs://n/stage/p1": b"B"}
    fs = FakeFS(before, concat_ok=False)
    assert not _try_fs_concat(fs, "hdfs://n/out/x.csv", None, list(before))
    assert fs.files == before
    fs = FakeFS({**before, "hdfs://n/stage/h": b"H"}, concat_ok=False)
    assert not _try_fs_concat(fs, "hdfs://n/out/x.csv", "hdfs://n/stage/h", list(before))
    assert "hdfs://n/out/x.csv" not in fs.files and all(p in fs.files for p in before)


def test_other_file_systems_skip_concat():
    fs = FakeFS({"s3a://b/p0": b"A", "s3a://b/p1": b"B"})
    assert not _try_fs_concat(fs, "s3a://b/out.csv", None, ["s3a://b/p0", "s3a://b/p1"])
    assert fs.calls == []


def test_header_strategy_follows_the_file_system():
    from ferry.sinks.layout import _header_in_parts
    # local/cloud: headers stay in the parts (a one-part output is a rename)
    assert _header_in_parts("csv", False, "file:/out/.stage")
    assert _header_in_parts("tsv", False, "s3a://b/out/.stage")
    # HDFS: a separate header part, so concat can join without copying
    assert not _header_in_parts("csv", False, "hdfs://nn/out/.stage")
    # gzip: always a separate header part; other formats have no header
    assert not _header_in_parts("csv", True, "file:/out/.stage")
    assert not _header_in_parts("ndjson", False, "file:/out/.stage")


def test_a_failing_copy_leaves_the_old_file(spark, tmp_path):
    import pytest
    from ferry.sinks.assemble import assemble
    target = str(tmp_path / "out.csv")
    open(target, "w").write("old")
    open(tmp_path / "p1", "w").write("h\n1\n")
    with pytest.raises(Exception):
        assemble(spark, [(target, [str(tmp_path / "p1"), str(tmp_path / "missing")])], repeated_header=True)
    assert open(target).read() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["out.csv", "p1"]


def test_repeated_headers_with_quoted_newlines(spark, tmp_path):
    from ferry.sinks.assemble import assemble
    for i in (1, 2):
        open(tmp_path / f"p{i}", "w").write(f'"a\nb",c\n{i},{i}\n')
    target = str(tmp_path / "out.csv")
    assemble(spark, [(target, [str(tmp_path / "p1"), str(tmp_path / "p2")])], repeated_header=True)
    assert open(target).read() == '"a\nb",c\n1,1\n2,2\n'


@pytest.mark.parametrize("rows", [[], [5], [3, 5], [0, 7]])
def test_xml_parts_without_rows(spark, tmp_path, rows):
    # a first part of length 0 took the root's start tag with it
    from ferry.sinks import layout
    target = str(tmp_path / "out.xml")
    layout.write_single(spark.range(0, 8, 1, 4).where(F.col("id").isin(rows)), "xml", target, xml_root="all", xml_row="one")
    root = ElementTree.parse(target).getroot()
    assert root.tag == "all" and [e.find("id").text for e in root] == [str(i) for i in rows]


def test_xml_of_a_table_whose_first_split_has_no_rows(spark, tmp_path):
    # one row group cut into splits: only the split around its middle has rows
    from ferry.plans import suite
    from ferry.session import job_session
    i = F.col("id")
    table = spark.range(5000).coalesce(1).select(
        i.alias("c_custkey"), F.concat(F.lit("Customer#"), i).alias("c_name"), (i % 25).cast("int").alias("c_nationkey"),
        (i / 4).alias("c_acctbal"), F.when(i % 7 > 0, F.lit("BUILDING")).alias("c_mktsegment"))
    table.write.option("compression", "none").parquet(str(tmp_path / "customer.parquet"))
    js = job_session(spark)
    js.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    js.conf.set("spark.sql.files.openCostInBytes", "1k")
    assert sorted(suite.xml_custom_root(js, str(tmp_path)).collect()) == sorted(table.collect())


def test_settings_of_sizes_with_a_unit(spark, tmp_path):
    from ferry.plans import runner, suite
    from ferry.session import job_session
    from ferry.sinks import layout
    js = job_session(spark)
    for key, value in (("maxPartitionBytes", "16m"), ("openCostInBytes", "1m")):
        js.conf.set(f"spark.sql.files.{key}", value)
    js.conf.set(layout.ASSEMBLE_MIN_BYTES_CONF, "8m")
    assert layout.assemble_min_bytes(js) == 8 << 20 and layout.in_scan_order(js, [1 << 30])
    runner.read_files_whole(js, [1 << 20])
    assert js.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    spark.range(10).write.parquet(str(tmp_path / "events.parquet"))
    assert suite._session(js, str(tmp_path), "events").conf.get("spark.sql.files.maxPartitionBytes") == "65536"

"""Output naming rules, table-tested on the reference's test names."""

import pytest

from ferry.functions import names
from ferry.functions.formats import (UnsupportedFormat, file_format, is_data_file,
                                     output_extension, reader_kind)


@pytest.mark.parametrize("path,base", [
    ("/d/test_file.parquet", "test_file"),
    ("/d/data.backup.csv", "data.backup"),
    ("/d/data*special.csv", "data*special"),
    ("/d/file_no_dots.csv", "file_no_dots"),
    ("/d/events.ndjson.gz", "events"),
    ("/d/events.csv.zst", "events"),
    ("gs://b/x/part-1.parquet", "part-1"),
    ("/d/noext", "noext"),
])
def test_output_base_name(path, base):
    assert names.output_base_name(path) == base


def test_build_output_filename():
    assert names.build_output_filename("part-1", "csv") == "part-1.csv"
    assert names.build_output_filename("part-1", "csv", "pre_", "_suf") == "pre_part-1_suf.csv"
    assert names.build_output_filename("part-1", "parquet", compressed=True) == "part-1.parquet.gz"


def test_chunk_names_number_from_one_before_suffix():
    assert names.chunk_filename("test_file", 1, "ndjson") == "test_file-1.ndjson"
    assert names.chunk_filename("a", 2, "csv", "p_", "_s", True) == "p_a-2_s.csv.gz"


@pytest.mark.parametrize("name,fixed", [
    ("test*dir", "testmergeddir"),
    ("data?files", "dataunknownfiles"),
    ("data[backup]", "databackup"),
    ("plain", "plain"),
])
def test_fix_glob_name(name, fixed):
    assert names.fix_glob_name(name) == fixed


def test_merged_filename():
    assert names.merged_filename("/t/test_parquet_dir", True, "ndjson") == \
        "test_parquet_dir_merged.ndjson"
    assert names.merged_filename("/t/subdir/", True, "ndjson") == "subdir_merged.ndjson"
    # no second "merged"
    assert names.merged_filename("/t/merged_data", True, "csv") == "merged_data.csv"
    assert names.merged_filename("/t/test*dir", True, "csv") == "testmergeddir.csv"
    assert names.merged_filename("/t/data[backup]", True, "csv") == "databackup_merged.csv"
    assert names.merged_filename("/t/one.csv", False, "ndjson", "p_", "_s") == \
        "p_one_merged_s.ndjson"


def test_default_output_dir():
    assert names.default_output_dir("/t/a/file.csv", False) == "/t/a"
    assert names.default_output_dir("/t/a/", True) == "/t/a"
    assert names.default_output_dir("gs://b/prefix/", True) == "gs://b"


@pytest.mark.parametrize("path,fmt", [
    ("a.CSV", "csv"), ("a.csv.gz", "csv"), ("x/y.JSONL", "jsonl"), ("b.parquet.zst", "parquet"),
    ("c.xml.bz2", "xml"), ("noext", ""),
])
def test_file_format_ignores_case(path, fmt):
    assert file_format(path) == fmt


def test_data_file_filter_and_dispatch():
    assert is_data_file("A.CSV") and is_data_file("e.ndjson.gz") and not is_data_file("x.txt")
    assert reader_kind("A.CSV") == "csv"
    assert reader_kind("a.jsonl") == "json"
    with pytest.raises(UnsupportedFormat, match="Unsupported extension: txt"):
        reader_kind("a.txt")
    with pytest.raises(UnsupportedFormat, match="xz"):
        reader_kind("a.csv.xz")
    assert output_extension("jsonl") == "json" and output_extension("ndjson") == "ndjson"
    with pytest.raises(UnsupportedFormat):
        output_extension("avro")


from hypothesis import given, strategies as st  # noqa: E402

NAME = st.text(alphabet=st.characters(whitelist_categories=("Ll", "Lu", "Nd"),
                                      whitelist_characters="-_ "), min_size=1, max_size=20)


@given(base=NAME, ext=st.sampled_from(["csv", "ndjson", "parquet", "json", "tsv", "xml"]),
       comp=st.sampled_from(["", ".gz", ".bz2", ".zst"]))
def test_output_base_name_inverts_naming(base, ext, comp):
    name = names.build_output_filename(base, ext) + comp
    assert names.output_base_name(f"/d/{name}") == base
    assert file_format(name) == ext


@given(base=NAME, chunk=st.integers(1, 10**6), prefix=NAME, suffix=NAME)
def test_chunk_names_are_distinct_per_chunk(base, chunk, prefix, suffix):
    a = names.chunk_filename(base, chunk, "csv", prefix, suffix)
    b = names.chunk_filename(base, chunk + 1, "csv", prefix, suffix)
    assert a != b and a.startswith(prefix) and a.endswith(f"{suffix}.csv")


def test_qualified_names_of_a_folder_take_one_lookup(spark, tmp_path):
    from ferry.sinks.fs import HadoopFS
    fs, plain = HadoopFS(spark), HadoopFS(spark)
    kinds = [f"{tmp_path}/a", f"file:{tmp_path}/a b%20", f"file://{tmp_path}//x/é.csv", f"{tmp_path}/x/", f"{tmp_path}/x/.",
             f"{tmp_path}/x/../y", f"{tmp_path}/c:d", "/a", "a", "file:/a", "file:///a", "a/b", f"{tmp_path}/[1]*.csv"]
    assert [fs.qualify(p) for p in kinds] == [plain._qualify(p) for p in kinds]
    fs._qualify = lambda p: p
    assert fs.qualify("gs://bucket/a.csv") == "gs://bucket/a.csv" and fs._qualified.keys().isdisjoint({"gs://bucket"})
    looked = []
    fs._qualify = lambda p: looked.append(p) or plain._qualify(p)
    names = [fs.qualify(f"{tmp_path}/many/{i}.csv") for i in range(500)]
    assert len(looked) == 1 and len(set(names)) == 500

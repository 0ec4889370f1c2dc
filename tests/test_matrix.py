"""Format × format conversion matrix: every reader with every writer (J3)."""

import pytest

from ferry import Job, run
from ferry.sources.catalogue import find_input_files
from ferry.sources.readers import ReadOptions, read_files

from tests.conftest import SF001

INPUTS = ["parquet", "csv", "tsv", "ndjson", "json", "xml"]
OUTPUTS = ["ndjson", "parquet", "csv", "tsv", "xml", "jsonl"]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """nation (25 rows) written once in every input format."""
    base = tmp_path_factory.mktemp("matrix")
    made = {}
    for fmt in INPUTS:
        out = str(base / f"src-{fmt}")
        run(spark, Job(input=f"{SF001}/nation.parquet", format="jsonl" if fmt == "json" else fmt,
                       output=out))
        made[fmt] = out
    return made


def _rows(df):
    return sorted((int(r.n_nationkey), r.n_name, int(r.n_regionkey)) for r in df.collect())


@pytest.mark.parametrize("src", INPUTS)
@pytest.mark.parametrize("dst", OUTPUTS)
def test_conversion(spark, sources, tmp_path, src, dst):
    expected = _rows(spark.read.parquet(f"{SF001}/nation.parquet"))
    out = str(tmp_path / "out")
    res = run(spark, Job(input=sources[src], format=dst, output=out))
    assert len(res.outputs) == 1
    back = read_files(spark, find_input_files(spark, out).paths, ReadOptions())
    assert _rows(back) == expected

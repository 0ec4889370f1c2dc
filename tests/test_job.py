"""Option exclusions and the job document."""

import pytest

from ferry.plans.job import Job, JobError


def v(**kw):
    return Job(input="/x", **kw).validated()


@pytest.mark.parametrize("kw,msg", [
    ({"format": "avro"}, "format: 'avro'"),
    ({"format": "csv", "fast_mode": True}, "cannot write csv"),
    ({"format": "ndjson", "fast_mode": True, "cols": "a"}, "cols has nothing"),
    ({"format": "ndjson", "fast_mode": True, "dedupe": True}, "dedupe is not"),
    ({"format": "ndjson", "fast_mode": True, "sql": "SELECT 1"}, "sql needs parsed"),
    ({"format": "ndjson", "fast_mode": True, "steps": ({"delete": "a"},)}, "steps need parsed"),
    ({"sql": "SELECT 1", "steps": ({"delete": "a"},)}, "writes none"),
    ({"format": "csv", "steps": ({"delete": "a"},)}, "JSON output format"),
    ({"format": "ndjson", "url": "http://x", "output": "gs://b/o"}, "cloud output"),
    ({"format": "ndjson", "rows": 10, "single_file": True}, "single_file wants one"),
    ({"sql": "SELECT 1", "url": "http://x"}, "delivers nothing"),
    ({"sql": "SELECT 1", "single_file": True}, "writes one result"),
    ({"sql": "SELECT 1", "rows": 5}, "not cut into chunks"),
    ({"format": "ndjson", "preview": 5, "url": "http://x"}, "preview sends nothing"),
    ({"count": True, "preview": 5}, "own result"),
])
def test_exclusions(kw, msg):
    with pytest.raises(JobError, match=msg.replace("(", r"\(").replace(")", r"\)")):
        v(**kw)


def test_modes_and_defaults():
    assert Job(input="/x", sql="SELECT 1").analytical
    assert Job(input="/x", count=True).analytical
    assert not Job(input="/x", format="csv", sql="SELECT 1").analytical
    assert Job(input="/x").out_format == "ndjson"
    # delivery defaults to 1000 rows per request (the documented intent)
    j = v(format="ndjson", url="http://x")
    assert j.rows == 1000 and any("1000" in w for w in j.warnings)
    assert v(format="ndjson", url="http://x", single_file=True).rows == 0
    # fast mode is fine for analytical counts
    assert v(count=True, fast_mode=True).analytical


def test_from_dict_request_body():
    j = Job.from_dict({"input_path": "/d", "format": "csv", "single_file": "all.csv",
                       "cols": "a,b", "dedupe": True, "rows": "0", "header": "X-A: 1",
                       "s3_key": "AK", "s3_secret": "SK", "prefix": "p_", "xml_root": "items"})
    assert j.single_file and j.single_file_name == "all.csv"
    assert j.headers == ("X-A: 1",) and j.xml_root == "items"
    assert j.credentials["s3_access_key"] == "AK"
    assert "SK" not in repr(j) and "AK" not in repr(j)
    with pytest.raises(JobError, match="input_path"):
        Job.from_dict({})
    with pytest.raises(JobError, match="not interpreted"):
        Job.from_dict({"input_path": "/d", "jq": ".a = 1"})


def test_credentials_stay_in_the_job_session(spark):
    from ferry.session import job_session
    from ferry.sinks.fs import HadoopFS
    from ferry.sources.cloud import apply_credentials
    a, b = job_session(spark), job_session(spark)
    apply_credentials(a, {"s3_access_key": "AK1", "s3_secret_key": "SK1"})
    assert HadoopFS(a)._conf.get("fs.s3a.access.key") == "AK1"
    assert HadoopFS(b)._conf.get("fs.s3a.access.key") != "AK1"
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.access.key") != "AK1"


def test_shuffle_width_follows_input_size(spark):
    from ferry.plans.runner import size_shuffles
    from ferry.session import job_session
    js = job_session(spark)
    base = int(js.conf.get("spark.sql.shuffle.partitions"))
    size_shuffles(js, 10 << 20)
    assert int(js.conf.get("spark.sql.shuffle.partitions")) == base
    size_shuffles(js, 100 << 40)  # 100 TiB
    assert int(js.conf.get("spark.sql.shuffle.partitions")) == 819200
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == base  # parent untouched


def test_verbose_logs_job_and_sql_without_secrets(spark, tmp_path, caplog):
    import logging
    from ferry import run
    f = tmp_path / "a.csv"
    f.write_text("a\n1\n")
    with caplog.at_level(logging.WARNING, logger="ferry"):
        run(spark, Job(input=str(f), sql="SELECT CAST(a AS VARCHAR) AS s FROM input_data;",
                       output=str(tmp_path / "o"), verbose=True,
                       credentials={"s3_access_key": "AKSECRET", "s3_secret_key": "SKSECRET"}))
    text = caplog.text
    assert "CAST(a AS STRING)" in text and "SECRET" not in text

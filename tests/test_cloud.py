"""Cloud settings without a network: scheme rules, client isolation, Arrow options."""

import pytest

from ferry import Job, JobError, run
from ferry.session import job_session
from ferry.sources import cloud

KEYS = {"s3_access_key": "AK", "s3_secret_key": "SK", "s3_region": "eu-west-1"}
HMAC = {"gcs_hmac_access": "GA", "gcs_hmac_secret": "GS"}


def test_schemes():
    assert [cloud.scheme_of(p) for p in ("s3a://b/x", "/tmp/x", "file:/x", "GS://b", "a/b:c", "wasbs://c@a/x")] == \
        ["s3a", "", "file", "gs", "", "wasbs"]


def test_unsupported_output_is_refused_before_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n")
    with pytest.raises(JobError, match="wasbs://"):
        run(spark, Job(input=str(tmp_path / "a.csv"), format="csv", output="wasbs://c@a/out"))


def test_arrow_options_come_from_the_jobs_settings(spark):
    a, b = job_session(spark), job_session(spark)
    cloud.apply_credentials(a, KEYS)
    cloud.apply_credentials(b, HMAC, ("gs://bucket/in", "/local"))
    got = cloud.store_options(a, "s3a://any/x")
    assert (got["kind"], got["access_key"], got["secret_key"], got["region"]) == ("s3", "AK", "SK", "eu-west-1")
    gs = cloud.store_options(b, "gs://bucket/x")
    assert (gs["kind"], gs["access_key"], gs["endpoint_override"]) == ("s3", "GA", cloud.GCS_S3_ENDPOINT)
    assert cloud.store_options(a, "gs://bucket/x") == {"kind": "gs"}
    assert cloud.store_options(b, "s3a://any/x")["access_key"] != "GA"
    assert cloud.store_options(a, "/tmp/x") == {}
    with pytest.raises(ValueError):
        cloud.store_options(a, "wasbs://c@a/x")


def test_jobs_with_keys_do_not_share_file_system_clients(spark):
    """The cache switch, seen on a scheme that is here: two jobs, two clients."""
    js = [job_session(spark), job_session(spark)]
    for s in js:
        s.conf.set("fs.file.impl.disable.cache", "true")   # what apply_credentials sets for s3a, s3, s3n and gs
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("file:/tmp")
    one, two = (path.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()) for s in js)
    assert one.hashCode() != two.hashCode()
    cloud.apply_credentials(js[0], {**KEYS, **HMAC}, ("gs://b/x",))
    conf = js[0]._jsparkSession.sessionState().newHadoopConf()
    other = js[1]._jsparkSession.sessionState().newHadoopConf()
    for s in ("s3a", "s3", "gs"):
        assert conf.get(f"fs.{s}.impl.disable.cache") == "true" and other.get(f"fs.{s}.impl.disable.cache") is None
    assert other.get("fs.s3a.access.key") is None


def test_arrow_file_systems_are_made_without_a_connection():
    from pyarrow import fs as pafs
    made = pafs.S3FileSystem(access_key="a", secret_key="b", region="x", endpoint_override="https://e.invalid")
    assert made.type_name == "s3"

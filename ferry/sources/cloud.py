"""Cloud credentials as Hadoop settings (never logged, never in reprs).

They are set on the job's own session, not on the shared SparkContext: Spark
copies a session's settings into the Hadoop configuration of that session's
reads and writes. Hadoop caches file-system clients by scheme, host and user,
whatever their keys, so a job with credentials also turns that cache off for
its schemes: its keys never serve another job, nor another job's keys this one.

HMAC keys for Google storage work through its S3-compatible interface: the
buckets of the job's ``gs://`` paths are mapped to the S3A client with Google's
endpoint, per bucket, so that S3 keys of the same job stay with S3.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import SparkSession

GCS_S3_ENDPOINT = "https://storage.googleapis.com"
S3A = "org.apache.hadoop.fs.s3a.S3AFileSystem"
#: schemes whose text outputs can be put together from parts (sinks.assemble)
ASSEMBLED_SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs")


def scheme_of(path: str) -> str:
    head, sep, _ = path.partition(":")
    return head.lower() if sep and "/" not in head else ""


def _own_clients(conf, *schemes: str) -> None:
    for s in schemes:
        conf.set(f"fs.{s}.impl.disable.cache", "true")


def apply_s3_credentials(spark: SparkSession, access_key: str, secret_key: str,
                         region: str | None = None, endpoint: str | None = None) -> None:
    conf = spark.conf
    conf.set("fs.s3a.access.key", access_key)
    conf.set("fs.s3a.secret.key", secret_key)
    if region:
        conf.set("fs.s3a.endpoint.region", region)
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)
    # s3:// paths go through the same connector.
    conf.set("fs.s3.impl", S3A)
    _own_clients(conf, "s3a", "s3", "s3n")


def apply_gcs_credentials(spark: SparkSession, keyfile: str | None = None,
                          hmac_access: str | None = None, hmac_secret: str | None = None,
                          paths: tuple = ()) -> None:
    conf = spark.conf
    if keyfile:
        conf.set("google.cloud.auth.service.account.enable", "true")
        conf.set("google.cloud.auth.service.account.json.keyfile", keyfile)
    if hmac_access and hmac_secret:
        conf.set("fs.gs.impl", S3A)
        for bucket in sorted({urlsplit(p).netloc for p in paths if scheme_of(p) == "gs"}):
            own = f"fs.s3a.bucket.{bucket}"
            conf.set(f"{own}.access.key", hmac_access)
            conf.set(f"{own}.secret.key", hmac_secret)
            conf.set(f"{own}.endpoint", GCS_S3_ENDPOINT)
            conf.set(f"{own}.path.style.access", "true")
    _own_clients(conf, "gs")


def apply_credentials(spark: SparkSession, creds: dict | None, paths: tuple = ()) -> None:
    if not creds:
        return
    if creds.get("s3_access_key") and creds.get("s3_secret_key"):
        apply_s3_credentials(spark, creds["s3_access_key"], creds["s3_secret_key"],
                             creds.get("s3_region"), creds.get("s3_endpoint"))
    if creds.get("gcs_keyfile") or creds.get("gcs_hmac_access"):
        apply_gcs_credentials(spark, creds.get("gcs_keyfile"), creds.get("gcs_hmac_access"),
                              creds.get("gcs_hmac_secret"), paths)


def store_options(spark: SparkSession, path: str) -> dict:
    """What an executor needs to open files of ``path``'s store with Arrow: taken
    from the session's Hadoop settings. Local paths need nothing."""
    scheme = scheme_of(path)
    if scheme not in ASSEMBLED_SCHEMES:
        raise ValueError(f"text outputs cannot be put together on {scheme}:// (use Parquet, or a local, HDFS, "
                         "S3 or Google storage path)")
    if scheme in ("", "file"):
        return {}
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    bucket = urlsplit(path).netloc

    def setting(name: str):
        return conf.get(f"fs.s3a.bucket.{bucket}.{name}") or conf.get(f"fs.s3a.{name}")

    if scheme in ("s3", "s3a", "s3n") or (scheme == "gs" and conf.get("fs.gs.impl") == S3A):
        return {"kind": "s3", "access_key": setting("access.key"), "secret_key": setting("secret.key"),
                "region": setting("endpoint.region"), "endpoint_override": setting("endpoint")}
    if scheme == "gs":
        return {"kind": "gs"}
    host = urlsplit(path)
    return {"kind": "hdfs", "host": host.hostname or "default", "port": host.port or 0}


def open_in_store(uri: str, mode: str, options: dict):
    """Open a file on an executor through an Arrow file system made from ``options``."""
    from pyarrow import fs as pafs
    place = urlsplit(uri)
    kind = options["kind"]
    if kind == "s3":
        given = {k: options[k] for k in ("access_key", "secret_key", "region", "endpoint_override") if options.get(k)}
        files, path = pafs.S3FileSystem(**given), place.netloc + place.path
    elif kind == "gs":
        files, path = pafs.GcsFileSystem(), place.netloc + place.path
    else:
        files, path = pafs.HadoopFileSystem(options["host"], options["port"]), place.path
    return files.open_output_stream(path) if "w" in mode else files.open_input_file(path)

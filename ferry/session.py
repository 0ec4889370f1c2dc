"""Spark session helpers.

``get_session`` builds a session with the settings every job here relies on
(AQE, UTC session time zone, Arrow). ``job_session`` gives each job its own
child session: temp views (``input_data``) and SQL settings stay private to
the job while the SparkContext, executors and cache are shared.
"""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "ferry",
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false") \
                             .config("spark.ui.showConsoleProgress", "false")
    for k, v in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    no_local_checksum_files(spark)
    return spark


def no_local_checksum_files(spark: SparkSession) -> None:
    """Local file system only: no ``.crc`` sidecar next to every output file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).setWriteChecksum(False)


BATCH_BYTES_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
INHERITED_PREFIXES = ("spark.sql.", "spark.ferry.", "fs.", "spark.hadoop.")
_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def _package_zip() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``ferry`` importable in the Python workers (once per application).

    Pandas functions (delivery, file assembly) run on executors and import
    this package there. The zipped package is written to the shared
    checkpoint folder and added with ``addPyFile``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        target = f"{checkpoint_root(spark).rstrip('/')}/ferry-pkg-{app}/ferry.zip"
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(_package_zip()))
        finally:
            out.close()
        sc.addPyFile(target)
        _SHIPPED.add(app)


def job_session(spark: SparkSession) -> SparkSession:
    """A child session for one job: own temp views and SQL conf.

    Double-quoted names are identifiers in the SQL stage (``"$email"``), as
    in the DuckDB dialect users write their SQL files in.
    """
    no_local_checksum_files(spark)
    ship_package(spark)
    js = spark.newSession()
    # A new session starts from the SparkConf only: carry over what the
    # caller set on its session at runtime (SQL settings, ours, Hadoop keys).
    for key, value in spark.conf.getAll.items():
        if key.startswith(INHERITED_PREFIXES) and js.conf.get(key, None) != value:
            try:
                js.conf.set(key, value)
            except Exception:  # noqa: BLE001 - static settings cannot be set per session
                pass
    js.conf.set("spark.sql.session.timeZone", "UTC")
    # what a Python worker is given at once is bounded in bytes too, not in rows only
    if js.conf.get(BATCH_BYTES_CONF, None) is None:
        js.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))
    # "quoted" names are identifiers only under ANSI mode (Spark 4's default;
    # set here in case the caller turned it off)
    js.conf.set("spark.sql.ansi.enabled", "true")
    js.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    return js


def conf_bytes(spark: SparkSession, key: str, default: int) -> int:
    """A size setting in bytes, written as Spark allows (``134217728``, ``128m``, ``1g``)."""
    value = spark.conf.get(key, None)
    if value is None:
        return default
    sizes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    size = value.strip()
    return -sizes.byteStringAsBytes(size[1:]) if size.startswith("-") else sizes.byteStringAsBytes(size)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system or bucket). Only when
    it is unset, as in local tests, is a local folder created and set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] != "local":      # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="ferry-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/ferry-{name}-{uuid.uuid4().hex[:12]}"


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for Python-side use of local paths."""
    if p.startswith("file://"):
        return p[len("file://"):]
    if p.startswith("file:"):
        return p[len("file:"):]
    return p


__all__ = ["get_session", "job_session", "conf_bytes", "checkpoint_root", "scratch_path",
           "local_path", "BASE_CONF"]

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.session import BATCH_BYTES, BATCH_BYTES_CONF, scratch_path, ship_package

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: later steps read files every executor can reach, so a
    lost executor never makes an expensive step run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded_key(column, seed: str):
    """A seeded order over a column: lower-case hex of its MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))


def smallest(df: DataFrame, n: int, key: str = "key", *then) -> DataFrame:
    """The ``n`` rows with the smallest hex hash in column ``key``.

    One count gives a hash threshold that about 2 n rows pass, so the rows that
    are ordered stay a few n, however many tasks there are. (Fewer than n rows
    pass with a chance below one in a billion for n >= 100, and ``n`` is an
    upper bound wherever this is used.)
    """
    total = df.count()
    if total > 4 * n:
        df = df.filter(F.col(key) < F.lit(f"{int(2 * n / total * 2 ** 32):08x}"))
    return df.orderBy(key, *then).limit(n)


def smallest_where(df: DataFrame, n: int, keep, key: str = "key", *then) -> DataFrame:
    """``smallest`` of the rows for which ``keep``, a costly condition, holds.

    Only rows below a threshold of the hash are looked at; it is raised until ``n`` of them
    pass or it takes in every row, so the rows that are the result are those of the whole table.
    """
    total = df.count()
    share = 4 * n / max(1, total)
    while True:
        some = df.filter(F.col(key) < F.lit(f"{int(share * 2 ** 32):08x}")) if share < 1 else df
        some = some.filter(keep)
        if share >= 1:
            break
        found = some.count()
        if found >= n:
            break
        share *= max(4, 2 * n / max(1, found))
    return some.orderBy(key, *then).limit(n)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and bound in bytes what one of
    them is given at once (unless the session says how much): 10,000 long texts are held
    several times over, by the JVM and by the worker."""
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES_CONF, None) is None:
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))


def single_thread_blas() -> None:
    for var in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(var, "1")

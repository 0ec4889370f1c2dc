"""Fixed-size chunks: chunk k holds rows [k*N, (k+1)*N) in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.functions.internal import CHUNK, IDX
from ferry.operators.rowindex import with_row_index


def add_chunks(df: DataFrame, rows: int, per_file: bool = False,
               stable: bool | None = None, keep_runs: bool = False) -> DataFrame:
    if rows <= 0:
        raise ValueError("rows per chunk must be positive")
    indexed = df if IDX in df.columns else with_row_index(df, IDX, per_file=per_file,
                                                          stable=stable, keep_runs=keep_runs)
    return indexed.withColumn(CHUNK, F.floor(F.col(IDX) / F.lit(rows)).cast("long"))


def chunk_manifest(df: DataFrame, rows: int, stable: bool | None = None) -> DataFrame:
    """One row per chunk: chunk (from 0), first_row, last_row, n_rows."""
    chunked = add_chunks(df, rows, stable=stable)
    return (chunked.groupBy(CHUNK)
            .agg(F.min(IDX).alias("first_row"), F.max(IDX).alias("last_row"),
                 F.count(F.lit(1)).alias("n_rows"))
            .withColumnRenamed(CHUNK, "chunk"))


def n_chunks(n_rows: int, rows: int) -> int:
    return (n_rows + rows - 1) // rows

"""Preview: the first N rows, nothing written.

The limit comes before the reshaping steps (as in the reference), so a
filter step can return fewer than N rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferry.operators.transform import apply_steps


def preview(df: DataFrame, n: int = 10, steps=None) -> DataFrame:
    head = df.limit(n)
    out, _ = apply_steps(head, steps)
    return out


def preview_pair(df: DataFrame, steps=None, raw_rows: int = 5,
                 transformed_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """Before/after pair: raw first rows and the transformed first rows."""
    return df.limit(raw_rows), preview(df, transformed_rows, steps)

"""Column selection (order kept, awkward names quoted) and row dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferry.functions.columns import col, parse_cols
from ferry.functions.internal import SOURCE_COLS, SRC_FILE


def select_columns(df: DataFrame, cols: str | list[str] | None) -> DataFrame:
    names = parse_cols(cols)
    if names is None:
        return df
    keep = [c for c in SOURCE_COLS if c in df.columns]
    return df.select([col(c) for c in names] + [col(c) for c in keep])


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SOURCE_COLS]


def dedupe(df: DataFrame, cols: str | list[str] | None = None,
           per_file: bool = False) -> DataFrame:
    """``SELECT DISTINCT`` over the chosen columns (all when none are given).

    Spark plans this as a hash aggregate with a map-side partial aggregate, so
    a row repeated many times (a hot duplicate) collapses inside each task
    before the shuffle. ``per_file`` keeps one copy per input file (the
    reference's per-file mode dedupes each file on its own).
    """
    names = parse_cols(cols) or data_columns(df)
    keys = [col(c) for c in names]
    if per_file and SRC_FILE in df.columns:
        return df.select(*keys, col(SRC_FILE)).distinct()
    return df.select(*keys).distinct()

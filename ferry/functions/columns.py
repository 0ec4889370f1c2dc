"""Column-name handling and nested→text rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_cols(spec: str | list[str] | None) -> list[str] | None:
    """``"a, b,$c"`` → ``["a", "b", "$c"]``; empty or ``*`` → None (all)."""
    if spec is None:
        return None
    if isinstance(spec, (list, tuple)):
        names = [c.strip() for c in spec if c and c.strip()]
    else:
        if spec.replace(" ", "") in ("", "*"):
            return None
        names = [c.strip() for c in spec.split(",") if c.strip()]
    return names or None


def quote(name: str) -> str:
    """Back-tick quote so ``a.b`` / ``$x`` / ``with space`` name one column."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StructType, T.ArrayType, T.MapType))


def nested_to_text(df: DataFrame) -> DataFrame:
    """Render struct/array/map columns as JSON text (for CSV/TSV sinks)."""
    if not any(is_nested(f.dataType) for f in df.schema.fields):
        return df
    return df.select([
        F.to_json(col(f.name)).alias(f.name) if is_nested(f.dataType) else col(f.name)
        for f in df.schema.fields
    ])


def temporal_to_text(df: DataFrame) -> DataFrame:
    """Cast timestamps to text the way SQL ``CAST(ts AS STRING)`` does.

    Text sinks then print ``2024-01-01 00:00:01.5`` rather than the writer's
    ``2024-01-01T00:00:01.500``.
    """
    kinds = (T.TimestampType, T.TimestampNTZType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df
    return df.select([
        col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, kinds) else col(f.name)
        for f in df.schema.fields
    ])


def widen_ints(df: DataFrame) -> DataFrame:
    """INT → BIGINT after CSV inference (integers read as 64-bit)."""
    if not any(isinstance(f.dataType, T.IntegerType) for f in df.schema.fields):
        return df
    return df.select([
        col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType)
        else col(f.name)
        for f in df.schema.fields
    ])

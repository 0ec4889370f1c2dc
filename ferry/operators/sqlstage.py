"""The SQL stage: user SQL over an ``input_data`` view.

Run inside a job session (``ferry.session.job_session``) so the view name
and the double-quoted-identifier setting stay private to the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferry.functions.sqltext import prepare_sql, rename_view
from ferry.functions.internal import SOURCE_COLS, refuse_reserved

VIEW = "input_data"


def run_sql(df: DataFrame, sql_text: str, view: str = VIEW,
            extra_views: dict[str, DataFrame] | None = None) -> DataFrame:
    spark = df.sparkSession
    hidden = [c for c in SOURCE_COLS if c in df.columns]
    (df.drop(*hidden) if hidden else df).createOrReplaceTempView(view)
    for name, other in (extra_views or {}).items():
        other.createOrReplaceTempView(name)
    out = spark.sql(prepare_sql(sql_text))
    refuse_reserved(out.columns)
    return out


def run_sql_as(df: DataFrame, sql_text: str, view: str) -> DataFrame:
    """The SQL stage with ``input_data`` under another view name, so several
    inputs can each be their own ``input_data`` in one session."""
    return run_sql(df, rename_view(sql_text, VIEW, view), view=view)


def read_sql_text(spark, sql: str) -> str:
    """``sql`` is SQL text, or the path of a ``.sql`` file (read via Spark)."""
    s = sql.strip()
    if s.lower().endswith(".sql") and "\n" not in s and " " not in s:
        return "\n".join(r.value for r in spark.read.text(s, wholetext=True).collect())
    return sql

"""Counts and dataset reports (the analytical mode and its templates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.functions.columns import col
from ferry.sources.readers import literals


def count_rows(df: DataFrame, name: str = "count") -> DataFrame:
    """``SELECT COUNT(*)``; over Parquet only footers are read (no columns)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def count_lines(spark, paths: list[str], name: str = "count") -> DataFrame:
    """Fast count: raw lines, no parsing."""
    return spark.read.text(literals(paths)).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first (ties broken by value)."""
    return (df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), col(column).asc_nulls_first()))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    c = col(column)
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.countDistinct(c).alias("unique_values"),
                  F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def group_average(df: DataFrame, key: str, value: str) -> DataFrame:
    return (df.groupBy(col(key))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(col(value)).alias("avg_value"))
            .orderBy(F.col("count").desc(), col(key).asc_nulls_first()))


def filter_top(df: DataFrame, column: str, value, order_col: str, n: int = 100,
               tie_break: str | None = None) -> DataFrame:
    """``WHERE c = v ORDER BY t DESC LIMIT n`` — planned as a top-k (TakeOrdered)."""
    order = [col(order_col).desc()]
    if tie_break:
        order.append(col(tie_break).desc())
    return df.where(col(column) == F.lit(value)).orderBy(*order).limit(n)


def monthly_rollup(df: DataFrame, ts: str, amount: str, since: str | None = None) -> DataFrame:
    """month, orders, total_revenue, avg_order_value by calendar month."""
    src = df if since is None else df.where(col(ts) >= F.lit(since).cast("timestamp"))
    # date_trunc gives a zoned timestamp; a naive input stays naive
    ts_type = df.schema[ts].dataType.simpleString()
    month = F.date_trunc("month", col(ts)).cast(ts_type).alias("month")
    return (src.groupBy(month)
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum(col(amount)).alias("total_revenue"),
                 F.avg(col(amount)).alias("avg_order_value"))
            .orderBy("month"))

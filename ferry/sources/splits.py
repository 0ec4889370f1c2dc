"""How Spark cuts files into splits."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ferry.session import conf_bytes


def split_bytes(spark: SparkSession, sizes: list[int]) -> int:
    """Largest split Spark cuts for these files (its documented sizing rule:
    ``min(maxPartitionBytes, max(openCostInBytes, total / minPartitionNum)``)."""
    conf = spark.conf
    max_part = conf_bytes(spark, "spark.sql.files.maxPartitionBytes", 128 << 20)
    open_cost = conf_bytes(spark, "spark.sql.files.openCostInBytes", 4 << 20)
    min_parts = conf.get("spark.sql.files.minPartitionNum", None)
    parallelism = int(min_parts) if min_parts else spark.sparkContext.defaultParallelism
    total = sum(s + open_cost for s in sizes)
    return min(max_part, max(open_cost, total // max(1, parallelism)))


def one_task_per_file(spark: SparkSession, sizes: list[int], splittable: bool) -> bool:
    if not splittable:
        return True
    return max(sizes, default=0) <= split_bytes(spark, sizes)

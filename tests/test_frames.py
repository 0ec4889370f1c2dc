"""Bucketed frames against plain windows."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferry.operators import frames


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = [(i, 1 if i % 3 == 0 else r.choice([None, 2, 3, 4]), r.choice([None, r.randrange(5000), r.randrange(200)]),
             r.choice([None, r.random()])) for i in range(700)]
    return spark.createDataFrame(data, "id long, user int, at long, value double")


@pytest.mark.parametrize("width", [1, 37, 1000, 10 ** 6])
def test_following_count(rows, width):
    got = frames.following_count(rows, ["user"], F.col("at"), width, "n")
    plain = Window.partitionBy("user").orderBy("at").rangeBetween(1, width)
    want = rows.withColumn("n", F.when(F.col("at").isNotNull(), F.count("at").over(plain)).otherwise(F.lit(0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


@pytest.mark.parametrize("n", [1, 6])
@pytest.mark.parametrize("width", [1, 50, 10 ** 6])
def test_trailing_rows(rows, n, width):
    own = {"total": F.count(F.lit(1)), "seen": F.count("value"), "first": F.min("id"), "low": F.min("value")}
    got = frames.trailing_rows(rows, ["user"], F.col("at"), ["at", "id"], n, width, own)
    plain = Window.partitionBy("user").orderBy("at", "id").rowsBetween(-n, 0)
    want = rows.select("*", *(a.over(plain).alias(k) for k, a in own.items()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_spread_over_its_buckets(rows):
    """The frames are keyed by bucket too: no group holds more than a bucket and its halo."""
    got = frames.following_count(rows, ["user"], F.col("at"), 100, "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user" in plan and frames.BUCKET in plan.split("hashpartitioning(user")[1][:80]
    biggest = rows.filter("user = 1 AND at IS NOT NULL").groupBy(F.floor(F.col("at") / 100)).count().agg(F.max("count")).first()[0]
    assert 2 * biggest < rows.filter("user = 1").count()

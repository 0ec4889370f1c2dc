"""Window frames over time whose groups are cut into buckets, for hot keys.

A window keyed by a user alone gives each user's rows to one task. Here the rows of a
key are cut by time into buckets, each with the rows of other buckets that its
frames reach (its halo), so a key that holds a third of all rows is spread over
as many tasks as it has buckets. Results are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.functions.internal import PREFIX

BUCKET, OWN, AT, HALO = PREFIX + "bucket", PREFIX + "own", PREFIX + "at", PREFIX + "halo"


def following_count(df: DataFrame, keys: list[str], micros: Column, width: int, name: str) -> DataFrame:
    """Per row, the rows of its key later by at most ``width`` microseconds (not at the
    same time). ``micros``: the time as a long; rows without a time count nothing.

    Buckets are ``width`` long, so a frame ends in its own bucket or the next one:
    every row also goes, as halo, to the bucket before its own.
    """
    timed = df.withColumn(AT, micros)
    bucket = F.floor(F.col(AT) / F.lit(width)).cast("long")
    copies = timed.withColumn(BUCKET, F.explode(F.array(bucket, bucket - 1))) \
        .withColumn(OWN, F.col(BUCKET) == bucket)
    frame = Window.partitionBy(*keys, BUCKET).orderBy(AT).rangeBetween(1, width)
    counted = copies.withColumn(name, F.count(AT).over(frame)).filter(F.col(OWN)).drop(BUCKET, OWN, AT)
    untimed = timed.filter(F.col(AT).isNull()).drop(AT).withColumn(name, F.lit(0).cast("long"))
    return counted.unionByName(untimed)


def trailing_rows(df: DataFrame, keys: list[str], micros: Column, order: list[str], n: int, width: int,
                  results: dict) -> DataFrame:
    """Aggregates over each row and the ``n`` rows of its key before it in ``order``
    (which must begin with the time and hold no ties).

    ``results``: name -> aggregate Column. Rows are bucketed by ``width`` microseconds
    of time. The halo of a bucket are the last n rows before it: each bucket gives
    its own last n, and the n buckets before hold at least n rows, or all there are.
    A key's buckets (one short row each) meet in one task, so keys should bound
    their number, as a user and a day do.
    """
    timed = df.withColumn(BUCKET, F.floor(micros / F.lit(width)).cast("long"))
    columns = df.columns
    bucket_keys = [*keys, BUCKET]
    back = Window.partitionBy(*bucket_keys).orderBy(*[F.desc(c) for c in order])
    last = timed.withColumn(AT, F.row_number().over(back)).filter(F.col(AT) <= n)
    packed = last.groupBy(*bucket_keys).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col(AT)).alias(AT), F.struct(*columns).alias("row")))).alias(HALO))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(-n, -1)
    halo = packed.withColumn(HALO, F.flatten(F.collect_list(HALO).over(before))) \
        .withColumn(HALO, F.explode(F.slice(HALO, F.greatest(F.size(HALO) - n + 1, F.lit(1)), n)))
    halo = halo.select(BUCKET, F.lit(False).alias(OWN), *(F.col(f"{HALO}.row").getField(c).alias(c) for c in columns))
    own = timed.select(BUCKET, F.lit(True).alias(OWN), *(F.col(c) for c in columns))
    frame = Window.partitionBy(*bucket_keys).orderBy(*order).rowsBetween(-n, 0)
    out = own.unionByName(halo).select(*columns, OWN, *(agg.over(frame).alias(name) for name, agg in results.items()))
    return out.filter(F.col(OWN)).drop(OWN)

"""Sharded vector search: every query block against every shard's index.

Rows are dealt evenly into shards (by row, not by id or content, so no hot id or
vector can fill one) and each shard is packed with its index into one row of a
staged table. Queries are packed into chunks. Each (shard, chunk) pair is one
task's work, so both sides of a pair fit in memory whatever the table size, and
a pair returns at most k rows per query. A rank per query merges the shards'
results.

A pair moves its index and its chunk once. Both are therefore as large as a task
can hold (``BLOCK_BYTES`` of vectors each), which keeps what is moved small against
the products computed: with b rows a block, queries x rows / b vectors from each
side. Up to b queries the index of a shard is moved once only. While there are
fewer shards than cores, they are smaller, down to ``LEAST_ROWS``.

Vectors of different lengths never meet: the length is part of every key.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.llm.common import ship, staged

BLOCK_BYTES = 32 << 20
LEAST_ROWS = 2048


def usable(emb: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim; without rows that can take no part: null id
    or vector, null, infinite or NaN components, no components at all."""
    v = F.col("embedding").cast("array<double>")
    return emb.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0") \
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))) \
        .withColumn("dim", F.size("v"))


def _matrix(column) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix."""
    column = column.combine_chunks()
    if hasattr(column, "chunks"):
        column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def search(rows: DataFrame, every: int, k: int, build, find, score_type: str,
           shard_rows: int | None = None, chunk_queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all other rows for each
    row whose id is divisible by ``every``.

    ``build(ids, matrix)`` makes a shard's index; ``find(index, query ids, query
    matrix, k)`` gives (query ids, row ids, scores), at most k per query, best
    first with ties to the smaller id, without rows of the query's own id.
    A query id that occurs several times is one query, of its largest vector.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    ship(spark)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, block = size.n, max(1, BLOCK_BYTES // (8 * (size.dim or 1)))
    shard_rows = shard_rows or min(block, max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    chunk_queries = chunk_queries or block
    shards = max(1, math.ceil(n / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def pack(table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        packed = pickle.dumps(build(ids[order], _matrix(table.column("v"))[order]), protocol=5)
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1],
                         "index": pa.array([packed], pa.binary())})

    indexes = staged(dealt.groupBy("dim", "shard").applyInArrow(pack, "dim int, shard int, index binary"),
                     "vector-indexes")

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.max("v").alias("v"))
    widest = asked.groupBy("vec_id").agg(F.max("dim").alias("dim"))
    asked = staged(asked.join(widest, ["vec_id", "dim"], "left_semi"), "vector-queries")
    chunks = max(1, math.ceil(asked.count() / chunk_queries))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))

    def bundle(table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids)
        packed = pickle.dumps((ids[order], _matrix(table.column("v"))[order]), protocol=5)
        return pa.table({"dim": table.column("dim")[:1], "chunk": table.column("chunk")[:1],
                         "queries": pa.array([packed], pa.binary())})

    bundles = asked.groupBy("dim", "chunk").applyInArrow(bundle, "dim int, chunk int, queries binary")
    key = ["dim", "shard", "chunk"]
    left = indexes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = bundles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def meet(a, b):
        found = [[], [], []]
        if a.num_rows and b.num_rows:
            index = pickle.loads(a.column("index")[0].as_py())
            ids, q = pickle.loads(b.column("queries")[0].as_py())
            found = find(index, ids, q, k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], kind)],
                        ["query_id", "vec_id", "score"])

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)) \
        .applyInArrow(meet, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")

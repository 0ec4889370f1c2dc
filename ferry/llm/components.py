"""Connected components of an undirected graph by contraction, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest-labelled way down) for every node of ``edges(a, b)``.

    Every round each node takes the smallest node next to it (or itself), edges
    are rewritten to these labels, and what became a loop or a repetition is
    dropped. With node names in random order, as digests are, the edges shrink
    by a constant factor each round, so the rounds grow with the logarithm of
    the graph. All state is in staged tables; nothing is collected.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "graph-edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = staged(nodes.withColumn("component", F.col("node")), "graph-labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                      .select(F.col("a").alias("n"), F.least("a", "m").alias("to")), "graph-hooks")
        labels = staged(labels.join(hook, F.col("component") == F.col("n"), "left")
                        .select("node", F.coalesce("to", "component").alias("component")), "graph-labels")
        left = hook.select(F.col("n").alias("a"), F.col("to").alias("ta"))
        right = hook.select(F.col("n").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").filter("ta <> tb")
        edges = staged(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
                       "graph-edges")
    return labels

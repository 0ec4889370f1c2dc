"""Mixing sources to target weights by capped water-filling.

Every source wants ``weight / sum of weights`` of the mix; no source may be
repeated more than ``max_epochs`` times. Sources whose share exceeds that cap
are clamped and the excess is shared again by weight among the rest, until no
share exceeds its cap. In closed form: with sources sorted by cap / weight,
the water level of row k is what the clamped rows before it leave, divided by
the weights from k on. The first row whose cap lies above its level fixes the
level of all rows from there on.

Documents then get ``floor(target / source size)`` whole repetitions, and the
fraction left is one more repetition of the source's documents in a seeded
order, as far as it reaches; the document at its edge is taken in part. So
what a source gives differs from its target by less than one word.

Everything is DataFrame work. A source that holds a third of all rows is never
sorted as a whole: the seeded order is cut into 4,096 hash buckets per source,
their sums locate the edge bucket, and only documents of that bucket are
ordered. Only the one-row-per-source table goes through one task.

Defined cases: a null text has size 0; the null source is a source of its own
and comes last; a source of size 0 gets target 0; null ids, repeated rows and
repeated ids are rows of their own (the seeded order breaks ties by id, then
size; rows equal in both are interchangeable); an empty table gives an empty
result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.llm.common import DOC_COLUMNS, seeded_key, staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix"
BUCKET_DIGITS = 3
#: most per-source rows (about 100 bytes each) that are broadcast
BROADCAST_SOURCES = 100_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET,
            max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size and target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w) \
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")) \
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(float(budget)) * F.sum("source_size").over(all_rows)
         - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level")))
                         .over(all_rows)["level"])
    return per.select("source", "source_size",
                      F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
                      .alias("target"))


def seeded(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the seeded order key of every document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))


def _key(seed: str) -> F.Column:
    return seeded_key(F.col("doc_id"), seed)


def rates(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sizes(source, size, key)``: s, source_size, target,
    whole repetitions, the fraction left in words, the bucket at its edge and the
    words in the buckets before that."""
    per = targets(sizes, weights, budget, max_epochs) \
        .withColumn("whole", F.when(F.col("source_size") > 0,
                                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("frac", F.col("target") - F.col("whole") * F.col("source_size")) \
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "frac")
    per = staged(per, "mix-targets")
    few = _few(per)
    run = Window.partitionBy("source").orderBy("bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("source", bucket().alias("bucket")).agg(F.sum("size").alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    edge = sums.join(few(per), F.col("source").eqNullSafe(F.col("s"))) \
        .filter((F.col("before") <= F.col("frac")) & (F.col("before") + F.col("n") > F.col("frac"))) \
        .groupBy("s").agg(F.max("bucket").alias("edge"), F.max("before").alias("before"))
    edge = edge.withColumnRenamed("s", "s2")
    return staged(per.join(few(edge), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-rates")


def bucket() -> F.Column:
    return F.substring("key", 1, BUCKET_DIGITS)


def _few(per: DataFrame):
    """A hot source must not meet in one join task: the per-source rows are
    broadcast where their counted number is small, else AQE splits the join."""
    return F.broadcast if per.count() <= BROADCAST_SOURCES else (lambda x: x)


def taken(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (source, size, key, doc_id and any others) with source_size, target,
    whole (repetitions) and part (words of one more)."""
    j = rows.join(_few(per)(per), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # no edge: the fraction covers the whole source (or nothing of it)
    clear = j.filter(F.col("edge").isNull() | (bucket() != F.col("edge"))) \
        .withColumn("part", F.when((F.col("frac") > 0) & (F.col("edge").isNull() | (bucket() < F.col("edge"))),
                                   F.col("size")).otherwise(F.lit(0)).cast("long"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cut = j.filter(bucket() == F.col("edge")) \
        .withColumn("left", F.floor(F.col("frac") - F.col("before")
                                    - F.coalesce(F.sum("size").over(inside), F.lit(0)))) \
        .withColumn("part", F.least("size", F.greatest("left", F.lit(0))).cast("long")).drop("left")
    return clear.unionByName(cut).withColumn("whole", F.col("whole").cast("int")).drop("frac", "edge", "before")


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, whole, part of every document."""
    rows = staged(seeded(docs, seed), "mix-sizes")
    return taken(rows, rates(rows, weights, budget, max_epochs)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", "part")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; the document at
    a source's edge once more as its first words."""
    docs = docs.select(DOC_COLUMNS)
    per = rates(staged(seeded(docs), "mix-sizes"))
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn("key", _key(SEED))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("part").cast("int")), " ")
    more = F.when(F.col("part") == 0, F.array().cast("array<string>")) \
        .when(F.col("part") == F.col("size"), F.array("text")).otherwise(F.array(first_words))
    return taken(rows, per) \
        .withColumn("text", F.explode(F.concat(F.array_repeat("text", F.col("whole")), more))) \
        .withColumn("n_chars", F.length("text").cast("long")).select(DOC_COLUMNS)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
      FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap / weight > level),
t AS (SELECT source, source_size,
             least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
r AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.whole * d.size + least(d.size, greatest(0, floor(r.target - r.whole * r.source_size
          - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

"""Plan shapes the scale design relies on, checked on the physical plans."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from ferry.functions import jsonsteps as S
from ferry.functions.internal import FID, SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.operators import chunking, project
from ferry.operators.transform import apply_steps
from ferry.sources.readers import read_files
from ferry.streaming.delivery import DeliveryConfig, deliver

from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_aggregates_before_the_shuffle(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    p = plan(project.dedupe(li, "l_returnflag,l_linestatus"))
    # partial HashAggregate below the Exchange: duplicates collapse map-side
    assert p.index("Exchange") < p.rindex("HashAggregate")
    assert p.count("HashAggregate") >= 2


def test_hot_duplicate_group_collapses_map_side(spark):
    """A third of all rows identical: dedupe still returns every distinct row."""
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    hot = ev.select(F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
                    .alias("user_id"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("event_type"))
                    .alias("event_type"))
    out = project.dedupe(hot)
    expected = hot.toPandas().drop_duplicates().shape[0]
    assert out.count() == expected
    assert out.where(F.col("event_type") == "hot").count() == 1


def test_filter_step_and_columns_reach_the_scan(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    out, _ = apply_steps(project.select_columns(ev, "user_id,event_type"),
                         [S.Where("event_type", "==", "purchase")])
    p = plan(out)
    assert "PushedFilters: [EqualNullSafe(event_type,purchase)]" in p
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in p


def test_row_index_on_a_scan_moves_no_data(spark):
    df = read_files(spark, [f"{SF01}/lineitem.parquet"], tag=True)
    p = plan(chunking.add_chunks(df, 1000))
    assert "BroadcastHashJoin" in p
    # the only exchange is the broadcast of the per-split table
    assert "Exchange hashpartitioning" not in p and "Exchange rangepartitioning" not in p


def test_top_k_per_group_limits_before_the_shuffle(spark):
    p = plan(E.queries()["q6_top3"](spark, SF01))
    assert p.count("WindowGroupLimit") >= 2
    assert p.index("Exchange") < p.rindex("WindowGroupLimit")


def test_delivery_groups_are_chunks(spark):
    df = read_files(spark, [f"{SF01}/events.parquet"], tag=True)
    log = deliver(df, DeliveryConfig(url="http://x", rows=500), transport=lambda r: (200, ""),
                  sleep=lambda s: None)
    p = plan(log)
    assert "FlatMapGroupsInPandas" in p and "source" in p and "chunk" in p
    # every group is one chunk of at most 500 rows
    sizes = log.select("n_rows").distinct().collect()
    assert max(r.n_rows for r in sizes) == 500


def test_parts_layout_moves_no_data(spark):
    df = read_files(spark, [f"{SF01}/lineitem.parquet"], tag=True)
    parts = (df.withColumn(FID, F.md5(SRC_FILE))
             .sortWithinPartitions(FID, SRC_BLOCK, SRC_POS))
    assert "Exchange" not in plan(parts)

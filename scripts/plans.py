"""Write PLANS.md: formatted physical plans of the main operators.

    python scripts/plans.py [sf_dir]

Each section names the operator, the plan property it relies on, and the
plan Spark chose (``explain("formatted")``, AQE's initial plan).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from ferry import Job, get_session  # noqa: E402
from ferry.functions import jsonsteps as S  # noqa: E402
from ferry.functions.internal import FID, SRC_BLOCK, SRC_FILE, SRC_POS  # noqa: E402
from ferry.operators import chunking, project, report  # noqa: E402
from ferry.operators.transform import apply_steps  # noqa: E402
from ferry.plans import suite  # noqa: E402
from ferry.plans.runner import explain_job  # noqa: E402
from ferry.sources.readers import read_files  # noqa: E402
from ferry.streaming.delivery import DeliveryConfig, deliver  # noqa: E402


def formatted(spark, df) -> str:
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(
        "formatted")
    text = df._jdf.queryExecution().explainString(mode)
    # file locations and ids vary between runs
    text = re.sub(r"file:[^\s,\]]+", "<file>", text)
    return re.sub(r"#\d+", "", text)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "16"})
    ev = spark.read.parquet(f"{sf}/events.parquet")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    tagged = read_files(spark, [f"{sf}/lineitem.parquet"], tag=True)
    sections = [
        ("Column selection + reshaping filter (T1, T11)",
         "Filter and projection reach the Parquet scan: PushedFilters and a pruned ReadSchema.",
         apply_steps(project.select_columns(ev, "user_id,event_type"),
                     [S.Where("event_type", "==", "purchase")])[0]),
        ("Dedupe (T3/T4)",
         "Partial HashAggregate before the Exchange: repeated rows collapse map-side, so a "
         "hot duplicate group costs one row per task in the shuffle.",
         project.dedupe(li, "l_returnflag,l_linestatus,l_quantity")),
        ("Dense row index + chunks (L4/L5)",
         "Per-split offsets (a table bounded by the number of splits, size-checked) are "
         "broadcast; the data itself is not shuffled or sorted.",
         chunking.add_chunks(tagged, 1000)),
        ("Parts of a merged or large per-file text output (K9/K10)",
         "What the writer gets for a large text merge: rows tagged by file and split, "
         "sorted inside each task, written with partitionBy(file, split). No Exchange: "
         "every task writes its own split's part; the parts are joined afterwards. "
         "Per-file outputs skip the sort while a task has few outputs.",
         tagged.withColumn(FID, F.md5(SRC_FILE))
               .sortWithinPartitions(FID, SRC_BLOCK, SRC_POS)),
        ("Profile (A4)",
         "Distinct counts as two-level aggregates, each with map-side partial aggregation.",
         ev.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("user_id").alias("unique_users"),
                F.countDistinct("event_type").alias("unique_events"))),
        ("Monthly rollup (A9)",
         "date_trunc group-by with partial aggregation; the WHERE is pushed to the scan.",
         report.monthly_rollup(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate",
                               "o_totalprice", since="1996-01-01")),
        ("Top 3 per user (Q6)",
         "WindowGroupLimit runs before the Exchange: a hot user sends at most 3 rows per "
         "task to the window.",
         suite.registry()["q6_top3"][0](spark, sf)),
        ("Range join (Q3)",
         "A RANGE-frame count per user: one exchange and sort, no pairs are formed.",
         suite.q3_range_join(spark, sf)),
        ("Delivery (K17)",
         "Rows become JSON text inside the JVM. Chunks inside one split are sent by "
         "MapInPandas where they are read (no exchange); only boundary chunks go through "
         "the (file, chunk) grouping, at most N rows each. Python only sends.",
         deliver(read_files(spark, [f"{sf}/events.parquet"], tag=True),
                 DeliveryConfig(url="http://collector.invalid/x", rows=1000),
                 transport=suite.ScriptedTransport(), sleep=suite._no_sleep)),
    ]
    out = ["# Physical plans of the main operators",
           "",
           f"Generated by `scripts/plans.py` on `{os.path.basename(sf)}` "
           "(`local[8]`, AQE on; initial plans).",
           ""]
    for title, why, df in sections:
        out += [f"## {title}", "", why, "", "```", formatted(spark, df).strip(), "```", ""]
    job = Job(input=f"{sf}/events.parquet", format="ndjson", cols="user_id,event_type",
              steps=({"select": {"field": "event_type", "value": "purchase"}},))
    text = re.sub(r"file:[^\s,\]]+", "<file>", explain_job(spark, job))
    out += ["## A whole job (`explain_job`)", "",
            "`Job(input=events.parquet, format=ndjson, cols=user_id,event_type, "
            "steps=[select event_type == purchase])`", "", "```",
            re.sub(r"#\d+", "", text).strip(), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()

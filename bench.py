"""Headline jobs timed at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query seconds), "unit",
"queries": {name: seconds}, "sf", "duckdb": {name: seconds}}. Each query runs
three times and the fastest run counts (timings on this machine are noisy).
"duckdb" times the same operation with the DuckDB engine the reference
drives (same machine, same files, in-process, so without the reference's
per-statement process start), as a point of comparison; chunking and
per-file SQL there use the reference's own loops. Set BENCH_DUCKDB=0 to
skip it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ferry import Job, get_session, run, scratch_path  # noqa: E402
from ferry.plans.suite import ScriptedTransport, _no_sleep  # noqa: E402
from ferry.sources.readers import read_files  # noqa: E402
from ferry.streaming.delivery import DeliveryConfig, deliver  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sf_of(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def timed(fn, repeat: int = 3) -> float:
    best = None
    for _ in range(repeat):
        t = time.perf_counter()
        fn()
        dt = time.perf_counter() - t
        best = dt if best is None else min(best, dt)
    return round(best, 3)


def main() -> None:
    spark = get_session(f"local[{CPUS}]", app_name="ferry-bench",
                        conf={"spark.sql.shuffle.partitions": str(int(CPUS) * 2),
                              "spark.driver.memory": "16g"})
    sf = SF_DIR
    # Inputs prepared once, outside the timings.
    nd = scratch_path(spark, "bench-ndjson")
    run(spark, Job(input=f"{sf}/events.parquet", format="ndjson", output=nd))
    parts = scratch_path(spark, "bench-parts")
    (spark.read.parquet(f"{sf}/lineitem.parquet").repartitionByRange(8, "l_orderkey")
     .sortWithinPartitions("l_orderkey").write.parquet(parts))

    def out(name):
        return scratch_path(spark, f"bench-{name}")

    rollup_sql = ("SELECT DATE_TRUNC('month', o_orderdate) AS month, COUNT(*) AS orders, "
                  "SUM(o_totalprice) AS total_revenue, AVG(o_totalprice) AS avg_order_value "
                  "FROM input_data WHERE o_orderdate >= '1996-01-01' "
                  "GROUP BY DATE_TRUNC('month', o_orderdate) ORDER BY month")
    profile_sql = ("SELECT COUNT(*) AS total_rows, COUNT(DISTINCT user_id) AS unique_users, "
                   "COUNT(DISTINCT event_type) AS unique_events FROM input_data")

    def deliver_events():
        df = read_files(spark, [f"{sf}/events.parquet"], tag=True)
        cfg = DeliveryConfig(url="http://collector.invalid/x", rows=1000, rate_delay=0.0)
        deliver(df, cfg, transport=ScriptedTransport(), sleep=_no_sleep).count()

    jobs = {
        "parquet_to_ndjson": lambda: run(spark, Job(input=f"{sf}/events.parquet",
                                                    format="ndjson", output=out("nd"))),
        "parquet_to_csv_lineitem": lambda: run(spark, Job(input=f"{sf}/lineitem.parquet",
                                                          format="csv", output=out("csv"))),
        "ndjson_parsed_copy": lambda: run(spark, Job(input=nd, format="ndjson",
                                                     output=out("nd2"))),
        "ndjson_fast_copy": lambda: run(spark, Job(input=nd, format="ndjson", fast_mode=True,
                                                   output=out("fast"))),
        "chunk_csv_1000": lambda: run(spark, Job(input=f"{sf}/events.parquet", format="csv",
                                                 rows=1000, output=out("chunks"))),
        "merge_csv": lambda: run(spark, Job(input=parts, format="csv", single_file=True,
                                            output=out("merge") + "/lineitem.csv")),
        "dedupe_csv": lambda: run(spark, Job(input=f"{sf}/lineitem.parquet", format="csv",
                                             cols="l_returnflag,l_linestatus,l_quantity,l_suppkey",
                                             dedupe=True, output=out("dedupe"))),
        "sql_per_file_parts": lambda: run(spark, Job(
            input=parts, format="csv", output=out("sqlpf"),
            sql="SELECT l_orderkey, l_partkey, l_quantity * l_extendedprice AS gross, "
                "upper(l_returnflag) AS flag FROM input_data WHERE l_discount > 0.02")),
        "sql_per_file_agg_parts": lambda: run(spark, Job(
            input=parts, format="csv", output=out("sqlagg"),
            sql="SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty "
                "FROM input_data GROUP BY l_returnflag, l_linestatus")),
        "monthly_rollup": lambda: run(spark, Job(input=f"{sf}/orders.parquet", sql=rollup_sql,
                                                 output=out("rollup"))),
        "profile_ndjson": lambda: run(spark, Job(input=nd, sql=profile_sql,
                                                 output=out("profile"))),
        "count_lineitem": lambda: run(spark, Job(input=f"{sf}/lineitem.parquet", count=True,
                                                 output=out("count"))),
        "deliver_chunks": deliver_events,
    }
    times = {name: timed(fn) for name, fn in jobs.items()}

    duck = {}
    if os.environ.get("BENCH_DUCKDB", "1") != "0":
        duck = duckdb_times(sf, nd, parts)
    print(json.dumps({
        "metric": "total_job_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_of(sf),
        "duckdb": duck,
    }))
    spark.stop()


def duckdb_times(sf: str, nd_dir: str, parts_dir: str) -> dict:
    """Same operations as single DuckDB statements (what the reference runs)."""
    try:
        import duckdb
    except ImportError:
        return {}
    nd_files = sorted(os.path.join(d, f) for d, _, fs in os.walk(nd_dir.replace("file:", ""))
                      for f in fs if f.endswith(".ndjson"))
    nd_list = "[" + ",".join(f"'{p}'" for p in nd_files) + "]"
    tmp = tempfile.mkdtemp(prefix="bench-duck-")
    con = duckdb.connect()
    con.execute(f"SET threads={CPUS}")
    ev, li, od = (f"read_parquet('{sf}/{t}.parquet')" for t in ("events", "lineitem", "orders"))
    stmts = {
        "parquet_to_ndjson": f"COPY (SELECT * FROM {ev}) TO '{tmp}/a.ndjson' (FORMAT JSON)",
        "parquet_to_csv_lineitem": f"COPY (SELECT * FROM {li}) TO '{tmp}/b.csv' (FORMAT CSV, HEADER)",
        "ndjson_parsed_copy": f"COPY (SELECT * FROM read_json_auto({nd_list})) TO '{tmp}/c.ndjson' (FORMAT JSON)",
        "merge_csv": f"COPY (SELECT * FROM {li}) TO '{tmp}/d.csv' (FORMAT CSV, HEADER)",
        "dedupe_csv": f"COPY (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_suppkey FROM {li}) TO '{tmp}/e.csv' (FORMAT CSV, HEADER)",
        "monthly_rollup": f"COPY (SELECT DATE_TRUNC('month', o_orderdate) AS month, COUNT(*), SUM(o_totalprice), AVG(o_totalprice) FROM {od} WHERE o_orderdate >= '1996-01-01' GROUP BY 1 ORDER BY 1) TO '{tmp}/f.csv' (FORMAT CSV, HEADER)",
        "profile_ndjson": f"SELECT COUNT(*), COUNT(DISTINCT user_id), COUNT(DISTINCT event_type) FROM read_json_auto({nd_list})",
        "count_lineitem": f"SELECT COUNT(*) FROM {li}",
    }
    out = {}
    for name, sql in stmts.items():
        try:
            out[name] = timed(lambda s=sql: con.execute(s).fetchall())
        except duckdb.Error:
            pass

    part_files = sorted(os.path.join(d, f) for d, _, fs in os.walk(parts_dir.replace("file:", ""))
                        for f in fs if f.endswith(".parquet"))

    def sql_per_file():
        # The reference's per-file SQL: one COPY per input file.
        for i, p in enumerate(part_files):
            con.execute(f"CREATE OR REPLACE TEMP VIEW input_data AS SELECT * FROM read_parquet('{p}'); "
                        f"COPY (SELECT l_orderkey, l_partkey, l_quantity * l_extendedprice AS gross, "
                        f"upper(l_returnflag) AS flag FROM input_data WHERE l_discount > 0.02) "
                        f"TO '{tmp}/pf-{i}.csv' (FORMAT CSV, HEADER)")

    def sql_agg_per_file():
        for i, p in enumerate(part_files):
            con.execute(f"CREATE OR REPLACE TEMP VIEW input_data AS SELECT * FROM read_parquet('{p}'); "
                        f"COPY (SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty "
                        f"FROM input_data GROUP BY l_returnflag, l_linestatus) "
                        f"TO '{tmp}/agg-{i}.csv' (FORMAT CSV, HEADER)")

    def chunk_loop():
        # The reference's chunking: one count, then one LIMIT/OFFSET query per chunk.
        n = con.execute(f"SELECT COUNT(*) FROM {ev}").fetchone()[0]
        for i, off in enumerate(range(0, n, 1000)):
            con.execute(f"COPY (SELECT * FROM {ev} LIMIT 1000 OFFSET {off}) "
                        f"TO '{tmp}/chunk-{i + 1}.csv' (FORMAT CSV, HEADER)")

    def line_copy():
        for i, p in enumerate(nd_files):
            con.execute(f"COPY (SELECT * FROM read_csv('{p}', header=false, "
                        f"columns={{'line': 'VARCHAR'}}, delim=chr(1), quote='', escape='')) "
                        f"TO '{tmp}/lines-{i}.ndjson' (FORMAT CSV, HEADER false, QUOTE '', "
                        f"DELIMITER chr(1))")

    for name, fn in (("chunk_csv_1000", chunk_loop), ("ndjson_fast_copy", line_copy),
                     ("sql_per_file_parts", sql_per_file),
                     ("sql_per_file_agg_parts", sql_agg_per_file)):
        try:
            out[name] = timed(fn)
        except duckdb.Error:
            pass
    return out


if __name__ == "__main__":
    main()

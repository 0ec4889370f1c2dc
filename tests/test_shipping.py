"""The package reaches the Python workers when the caller's cwd is elsewhere."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_delivery_runs_from_another_directory(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        from ferry.session import job_session
        from ferry.sources.readers import read_files
        from ferry.streaming.delivery import DeliveryConfig, deliver
        js = job_session(spark)
        df = read_files(js, ["/root/testdata/sf0.001/events.parquet"], tag=True)
        log = deliver(df, DeliveryConfig(url="http://x", rows=400, rate_delay=0.0),
                      transport=lambda r: (200, "ok"), sleep=lambda s: None)
        print("ATTEMPTS", log.count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=300)
    assert "ATTEMPTS 3" in out.stdout, out.stderr[-2000:]

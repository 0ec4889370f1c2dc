"""Jobs survive task loss: Spark re-runs failed tasks and results stay whole."""

import json
import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_delivery_and_chunk_writes_survive_task_failures(tmp_path):
    script = textwrap.dedent(f"""
        import json, os, sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        # local[2, 4]: two task slots, a failed task is retried up to 4 times
        spark = (SparkSession.builder.master("local[2,4]")
                 .config("spark.ui.enabled", "false").getOrCreate())
        from ferry import Job, run

        class Flaky:
            # The first attempt of every task that posts chunk 2 dies mid-way,
            # as if its executor were lost; the retry succeeds.
            def __init__(self, folder):
                self.folder = folder
            def __call__(self, req):
                mark = os.path.join(self.folder, f"crashed-{{req.chunk}}")
                if req.chunk == 2 and not os.path.exists(mark):
                    open(mark, "w").close()
                    raise RuntimeError("executor lost")
                with open(os.path.join(self.folder, "received.ndjson"), "a") as fh:
                    fh.write(json.dumps({{"chunk": req.chunk,
                                          "key": req.headers["Idempotency-Key"],
                                          "n": req.body.count(b"\\n")}}) + "\\n")
                return 200, "ok"

        res = run(spark, Job(input="/root/testdata/sf0.001/orders.parquet", format="csv",
                             url="http://x", rows=400, output={str(tmp_path / 'out')!r}),
                  transport=Flaky({str(tmp_path)!r}), sleep=lambda s: None)
        log = res.delivery_log.collect()
        print("LOG", json.dumps(sorted((r.chunk, r.http_code) for r in log)))
        print("FILES", len(res.outputs))
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "LOG" in out.stdout, out.stderr[-3000:]
    log = json.loads(out.stdout.split("LOG", 1)[1].splitlines()[0])
    assert log == [[0, 200], [1, 200], [2, 200], [3, 200]]
    assert "FILES 4" in out.stdout
    got = [json.loads(x) for x in open(tmp_path / "received.ndjson")]
    # every chunk arrived whole; a repeat (from a retried task) carries the same key
    by_chunk = {}
    for g in got:
        by_chunk.setdefault(g["chunk"], set()).add((g["key"], g["n"]))
    assert sorted(by_chunk) == [0, 1, 2, 3]
    assert all(len(v) == 1 for v in by_chunk.values())
    assert sum(n for v in by_chunk.values() for _, n in v) == 1500
    assert os.path.exists(tmp_path / "crashed-2")
    csv_rows = sum(len(open(os.path.join(tmp_path / "out", f)).read().splitlines()) - 1
                   for f in os.listdir(tmp_path / "out") if f.endswith(".csv"))
    assert csv_rows == 1500

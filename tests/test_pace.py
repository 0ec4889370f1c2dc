"""One pace for all senders of a job: at most so many requests a second, however
late, slow or often retried any of them is."""

import heapq

import pytest
from pyspark.sql import functions as F

from ferry import Job, run
from ferry.sources.readers import read_files
from ferry.streaming.delivery import DeliveryConfig, Pace, deliver, record_lines, send_paced

from tests.conftest import SF001, write


class Clock:
    """A task's own fake clock: it starts late by chance and only moves by sleeping and sending."""

    def __init__(self):
        self.now = None

    def __call__(self):
        if self.now is None:
            from pyspark import TaskContext
            self.now = 1000.0 + 0.37 * TaskContext.get().partitionId() ** 2
        return self.now

    def sleep(self, seconds):
        self.now = self() + seconds

    def send(self, req):
        """Every third chunk fails once; every fifth takes 1.3 s, the others 20 ms."""
        self.now = self() + (1.3 if req.chunk % 5 == 0 else 0.02)
        return (500 if req.chunk % 3 == 0 and req.attempt == 1 else 200), "ok"


def _never_above(starts_ms, rate):
    """No window of a second holds more than ``rate`` starts (starts are on a grid, rounded to ms)."""
    starts = sorted(starts_ms)
    for i, first in enumerate(starts):
        within = sum(1 for s in starts[i:] if s < first + 1000 - 1)
        assert within <= rate, (first, within)


def test_eight_tasks_keep_one_pace(spark):
    df = read_files(spark, [f"{SF001}/events.parquet"], tag=True)
    clock = Clock()
    records = record_lines(df, 5).withColumn("source", F.concat("source", (F.col("chunk") % 3).cast("string")))
    spark_tasks = 8
    parallelism = spark.sparkContext.defaultParallelism
    cfg = DeliveryConfig(url="http://x", rows=5, max_rate=10.0, backoff_unit=0.05)
    log = send_paced(records, cfg, clock.send, clock.sleep, clock, max_concurrency=spark_tasks)
    assert log.rdd.getNumPartitions() == min(spark_tasks, parallelism)
    rows = log.collect()
    assert sum(r.n_rows for r in rows if r.outcome == "delivered") == 1000
    assert len(rows) == 200 + 67 and {r.outcome for r in rows} == {"delivered", "retry"}
    _never_above([r.started_ms for r in rows], 10)


@pytest.mark.parametrize("tasks", [1, 8, 16])
def test_lanes_share_the_slots(tasks):
    """Senders driven in the order of their own clocks, some late, slow or asleep for long."""
    class Own:
        def __init__(self, at):
            self.now = at

        def __call__(self):
            return self.now

        def sleep(self, seconds):
            self.now += seconds

    senders = []
    for lane in range(tasks):
        clock = Own(1000 + 0.73 * lane)
        senders.append((clock.now, lane, clock, Pace(lane, tasks, 10.0, clock.sleep, clock)))
    heapq.heapify(senders)
    starts = []
    for k in range(400):
        _, lane, clock, pace = heapq.heappop(senders)
        pace.wait()
        starts.append(round(clock.now * 1000))
        clock.now += 2.1 if (k + lane) % 7 == 0 else 0.0
        heapq.heappush(senders, (clock.now, lane, clock, pace))
    assert len(set(starts)) == 400
    _never_above(starts, 10)
    if tasks == 8:
        # slots are not wasted: far more than one sender's share is used
        assert 400 / ((max(starts) - min(starts)) / 1000) > 4


def test_paced_chunks_are_whole_and_in_order(spark, tmp_path):
    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"seq": {i}, "pad": "{"q" * 40}"}}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_files(spark, [f], tag=True)
        log = deliver(df, DeliveryConfig(url="http://x", rows=300, max_rate=10.0),
                      transport=lambda r: (200, ",".join(x.split(b",")[0].split(b":")[1].decode()
                                                         for x in r.body.splitlines())),
                      sleep=lambda s: None)
        rows = log.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.chunk: [int(x) for x in r.response.split(",")] for r in rows}
    assert len(rows) == 67
    assert got == {c: list(range(c * 300, min(20000, c * 300 + 300))) for c in range(67)}


def test_groups_of_files_are_sent_in_one_stage_with_their_names(spark, tmp_path):
    """Files with different columns, and ordered SQL per file: one log, one pace, own keys."""
    write(str(tmp_path / "in" / "a.csv"), "k,v\n1,2\n3,4\n5,6\n")
    write(str(tmp_path / "in" / "b.csv"), "x\nq\nr\n")
    res = run(spark, Job(input=str(tmp_path / "in"), format="ndjson", rows=2, url="http://x",
                         output=str(tmp_path / "o1")),
              transport=lambda r: (200, r.body.decode()), sleep=lambda s: None)
    seen = {(r.file, r.response) for r in res.delivery_log.collect()}
    assert seen == {("a-1", '{"k":1,"v":2}\n{"k":3,"v":4}\n'), ("a-2", '{"k":5,"v":6}\n'),
                    ("b-1", '{"x":"q"}\n{"x":"r"}\n')}
    write(str(tmp_path / "two" / "a.csv"), "k\n1\n2\n3\n")
    write(str(tmp_path / "two" / "b.csv"), "k\n7\n8\n")
    res = run(spark, Job(input=str(tmp_path / "two"), format="ndjson", rows=2, url="http://x",
                         sql="SELECT k FROM input_data ORDER BY k DESC", output=str(tmp_path / "o2")),
              transport=lambda r: (200, r.headers["Idempotency-Key"] + "|" + r.body.decode()), sleep=lambda s: None)
    rows = res.delivery_log.collect()
    assert {(r.file, r.response.split("|")[1]) for r in rows} == {
        ("a-1", '{"k":3}\n{"k":2}\n'), ("a-2", '{"k":1}\n'), ("b-1", '{"k":8}\n{"k":7}\n')}
    assert len({r.response.split("|")[0] for r in rows}) == 3


def test_nothing_to_send(spark):
    df = read_files(spark, [f"{SF001}/events.parquet"], tag=True).where("event_id < 0")
    assert deliver(df, DeliveryConfig(url="http://x", max_rate=10.0), transport=lambda r: (200, "")).count() == 0

"""Batched delivery to an HTTP endpoint, from the executors.

Rows are numbered and cut into chunks of N (N bounds every group, default
1000). Each chunk's records are rendered to NDJSON inside the JVM
(``to_json``), so Python only joins prepared lines and sends one POST per
chunk, on the executors; the result is one log row per attempt as a
DataFrame, and nothing is collected. Chunks inside one input split are sent
where they are read; only chunks crossing a split boundary are shuffled
together (``groupBy(file, chunk).applyInPandas``).

One pace over all tasks (``DeliveryConfig.max_rate``, always on for jobs): the
clock is cut into slots of 1/rate seconds, and slot k belongs to lane k mod
lanes. A chunk's lane follows from its number, a lane's rows are one sorted
partition (rows spill to disk, a chunk at a time is in Python), and every
attempt, retries too, waits for the lane's next slot. So all senders
together start at most ``max_rate`` requests a second, however late or slow
any of them is, as far as the executors' clocks agree, and nothing is
asked of the driver. Lanes are as few as the requests in flight; a lane of
a rate-limited delivery holds what it can send, not a share of a table read
at full speed.

Retry policy (per chunk): up to 3 attempts; 2xx done; 429 waits 2·n units;
5xx, other codes and network errors wait n units; other 4xx stop at once.
Without ``max_rate`` a task waits ``rate_delay`` seconds before each POST, so
the total rate is at most (concurrent tasks / rate_delay). ``max_concurrency``
caps all sending tasks together.

Spark may re-run a task (executor loss), so delivery is at-least-once; every
request carries an ``Idempotency-Key`` of job id, source path and chunk number
for the receiver to drop repeats.
"""

from __future__ import annotations

import hashlib
import http.client
import math
import time
import urllib.parse
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.functions.columns import col, temporal_to_text
from ferry.session import ship_package
from ferry.operators.chunking import add_chunks
from ferry.operators.rowindex import RUN_COLS, RUN_END, RUN_LAST, RUN_ORDERED, RUN_START
from ferry.functions.names import output_base_name
from ferry.functions.internal import CHUNK, IDX, PREFIX, SOURCE_COLS, SRC_FILE

LOG_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("chunk", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("http_code", T.IntegerType()),
    T.StructField("response", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("started_ms", T.LongType()),
    T.StructField("ended_ms", T.LongType()),
])

WHOLE = PREFIX + "whole"
NETWORK_ERROR = 0
MAX_ATTEMPTS = 3
#: requests a second of a job, over all tasks
MAX_RATE = 10.0
LANES = 16
LANE = PREFIX + "lane"


BLOCK = 1 << 20


@dataclass(frozen=True)
class FileBody:
    """A request's body that stays in its file: read in blocks, anew for every attempt."""
    uri: str
    length: int
    options: dict

    def __len__(self) -> int:
        return self.length

    def blocks(self):
        from ferry.sinks.assemble import open_file
        with open_file(self.uri, "rb", self.options) as src:
            while block := src.read(BLOCK):
                yield block


@dataclass(frozen=True)
class Request:
    url: str
    content: bytes | FileBody
    headers: dict
    chunk: int
    attempt: int

    @property
    def body(self) -> bytes:
        """The whole body, for transports that want it at once."""
        return b"".join(self.blocks())

    def blocks(self):
        """The body in order, never more than a block of a file at once."""
        return self.content.blocks() if isinstance(self.content, FileBody) else iter((self.content,))


class HttpTransport:
    """POST with the standard library: a limit for connecting and one for the
    whole exchange (10 s and 30 s), however slowly an answer trickles in."""

    def __init__(self, connect: float = 10.0, total: float = 30.0):
        self.connect, self.total = connect, total

    def __call__(self, req: Request) -> tuple[int, str]:
        url = urllib.parse.urlsplit(req.url)
        kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
        end = time.monotonic() + self.total
        conn = kind(url.hostname, url.port, timeout=min(self.connect, self.total))

        def left() -> float:
            rest = end - time.monotonic()
            if rest <= 0:
                raise TimeoutError(f"no complete answer within {self.total:g} s")
            return rest

        try:
            conn.connect()
            conn.sock.settimeout(left())
            def sent():
                for block in req.blocks():
                    conn.sock.settimeout(left())
                    yield block

            conn.request("POST", (url.path or "/") + (f"?{url.query}" if url.query else ""),
                         body=sent(), headers={**req.headers, "Content-Length": str(len(req.content))})
            conn.sock.settimeout(left())
            answer = conn.getresponse()
            parts = []
            while piece := answer.read1(1 << 16):
                parts.append(piece)
                if conn.sock is not None:
                    conn.sock.settimeout(left())
                left()
            return int(answer.status), b"".join(parts).decode("utf-8", errors="replace")
        finally:
            conn.close()


@dataclass(frozen=True)
class DeliveryConfig:
    url: str
    rows: int = 1000
    headers: tuple = ()
    max_attempts: int = MAX_ATTEMPTS
    rate_delay: float = 0.1
    max_rate: float | None = None
    backoff_unit: float = 1.0
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    name_prefix: str = "chunk"


def header_dict(headers) -> dict:
    out = {}
    for h in headers:
        if ":" not in h:
            raise ValueError(f"header must be 'Name: value': {h!r}")
        k, v = h.split(":", 1)
        out[k.strip()] = v.strip()
    if not any(k.lower() == "content-type" for k in out):
        out["Content-Type"] = "application/json"
    return out


def next_wait(status: int, attempt: int, unit: float) -> float | None:
    """Seconds to wait before the next attempt; None = stop trying."""
    if 200 <= status < 300:
        return None
    if status == 429:
        return 2 * attempt * unit
    if 400 <= status < 500:
        return None
    return attempt * unit


class Pace:
    """The slots of one lane: ``wait()`` returns at the start of the lane's next one."""

    def __init__(self, lane: int, lanes: int, rate: float, sleep=time.sleep, clock=time.time):
        self.lane, self.lanes, self.gap = lane, lanes, 1.0 / rate
        self.sleep, self.clock, self.used = sleep, clock, None

    def wait(self) -> None:
        now = self.clock()
        slot = math.ceil(now / self.gap)
        slot += (self.lane - slot) % self.lanes
        if self.used is not None:
            slot = max(slot, self.used + self.lanes)
        self.used = slot
        self.sleep(max(0.0, slot * self.gap - now))


def post_chunk(lines: list[str], chunk: int, cfg: DeliveryConfig, transport,
               sleep=time.sleep, source: str | None = None, wait=None, clock=time.time) -> list[dict]:
    """Send one chunk with the retry policy; one log record per attempt."""
    body = ("\n".join(lines) + "\n").encode("utf-8")
    base = output_base_name(source) if source else cfg.name_prefix
    return post_body(body, len(lines), f"{base}-{chunk + 1}", chunk, cfg, transport, sleep, source,
                     wait, clock)


def idempotency_key(cfg: DeliveryConfig, chunk: int, source: str | None) -> str:
    """Unique per job, source path and chunk (files of one name in two folders differ)."""
    if not source:
        return f"{cfg.job_id}-{cfg.name_prefix}-{chunk}"
    place = hashlib.sha1(source.encode("utf-8")).hexdigest()[:16]
    return f"{cfg.job_id}-{place}-{output_base_name(source)}-{chunk}"


def post_body(body: bytes | FileBody, n_rows: int | None, name: str, chunk: int, cfg: DeliveryConfig,
              transport, sleep=time.sleep, source: str | None = None, wait=None,
              clock=time.time) -> list[dict]:
    """Send one body with the retry policy; one log record per attempt. ``wait()``
    comes before every attempt (default: ``rate_delay`` seconds)."""
    headers = header_dict(cfg.headers)
    headers["Idempotency-Key"] = idempotency_key(cfg, chunk, source)
    records = []
    for attempt in range(1, cfg.max_attempts + 1):
        if wait is not None:
            wait()
        else:
            sleep(cfg.rate_delay)
        start = clock()
        try:
            status, text = transport(Request(cfg.url, body, headers, chunk, attempt))
        except (OSError, http.client.HTTPException) as e:
            status, text = NETWORK_ERROR, f"network error: {e}"
        end = clock()
        pause = next_wait(status, attempt, cfg.backoff_unit)
        ok = 200 <= status < 300
        last = ok or pause is None or attempt == cfg.max_attempts
        records.append({
            "source": source, "chunk": chunk, "attempt": attempt,
            "timestamp": datetime.fromtimestamp(start, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "file": name, "url": cfg.url, "http_code": status, "response": text,
            "duration_ms": int(round((end - start) * 1000)), "n_rows": n_rows,
            "outcome": "delivered" if ok else ("failed" if last else "retry"),
            "started_ms": int(start * 1000), "ended_ms": int(end * 1000),
        })
        if last:
            break
        sleep(pause)
    return records


def _source(v) -> str | None:
    return None if v is None or (isinstance(v, float) and pd.isna(v)) else str(v)


def record_lines(df: DataFrame, rows: int, stable: bool | None = None,
                 per_file: bool = False) -> DataFrame:
    """``df`` as rows (source, chunk, idx, line, and WHOLE: the chunk lies inside one
    input run, so its rows are together and in order). The columns are the same
    for every ``df``, so several can be united and sent at one pace."""
    hidden = set(SOURCE_COLS) | set(RUN_COLS) | {IDX, CHUNK}
    data_cols = [c for c in df.columns if c not in hidden]
    chunked = df if CHUNK in df.columns else add_chunks(df, rows, per_file=per_file,
                                                        stable=stable, keep_runs=True)
    source = F.col(SRC_FILE) if SRC_FILE in chunked.columns else F.lit(None).cast("string")
    if all(c in chunked.columns for c in RUN_COLS):
        lo = F.col(CHUNK) * F.lit(rows)
        whole = (F.col(RUN_ORDERED) & (lo >= F.col(RUN_START))
                 & ((lo + F.lit(rows - 1) <= F.col(RUN_END)) | F.col(RUN_LAST)))
    else:
        whole = F.lit(False)
    shown = temporal_to_text(chunked.select(*[col(c) for c in data_cols], IDX, CHUNK,
                                            source.alias(SRC_FILE), whole.alias(WHOLE)))
    return shown.select(
        F.col(SRC_FILE).alias("source"), F.col(CHUNK).alias("chunk"), F.col(IDX).alias("idx"), WHOLE,
        F.to_json(F.struct(*[col(c) for c in data_cols]),
                  {"ignoreNullFields": "false"}).alias("line"))


def _chunks(batches):
    """(source, chunk, lines, lane) of rows whose chunks are contiguous and in order."""
    key, lines, lane = None, [], 0
    for pdf in batches:
        if pdf.empty:
            continue
        keys = pdf["source"].astype(str) + "\x00" + pdf["chunk"].astype(str)
        starts = (keys != keys.shift()).to_numpy().nonzero()[0].tolist() + [len(pdf)]
        for a, b in zip(starts[:-1], starts[1:]):
            k = (_source(pdf["source"].iloc[a]), int(pdf["chunk"].iloc[a]))
            if k != key and key is not None:
                yield *key, lines, lane
                lines = []
            key = k
            lane = int(pdf[LANE].iloc[a]) if LANE in pdf else 0
            lines += pdf["line"].iloc[a:b].tolist()
    if key is not None:
        yield *key, lines, lane


def deliver(df: DataFrame, cfg: DeliveryConfig, transport=None, sleep=time.sleep,
            max_concurrency: int | None = None, stable: bool | None = None,
            per_file: bool = False) -> DataFrame:
    """POST ``df`` in chunks of ``cfg.rows``; returns the attempt log (lazy).

    With ``cfg.max_rate`` all chunks go through ``send_paced``. Otherwise a
    chunk that lies inside one input run (split or partition) is already
    contiguous and in order inside one task: it is sent from there
    (``mapInPandas``), with no shuffle. Only chunks that cross a run
    boundary — at most two per run — are gathered by
    ``groupBy(file, chunk).applyInPandas``.
    """
    ship_package(df.sparkSession)
    transport = transport or HttpTransport()
    records = record_lines(df, cfg.rows, stable, per_file)
    if cfg.max_rate:
        return send_paced(records, cfg, transport, sleep, max_concurrency=max_concurrency)
    columns = [f.name for f in LOG_SCHEMA.fields]

    def send_in_place(batches):
        for source, chunk, lines, _ in _chunks(batches):
            yield pd.DataFrame(post_chunk(lines, chunk, cfg, transport, sleep, source=source), columns=columns)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rows = post_chunk(pdf["line"].tolist(), int(pdf["chunk"].iloc[0]), cfg, transport,
                          sleep, source=_source(pdf["source"].iloc[0]))
        return pd.DataFrame(rows, columns=columns)

    inside = (records.where(F.col(WHOLE)).drop(WHOLE)
              .mapInPandas(send_in_place, schema=LOG_SCHEMA))
    edges = records.where(~F.col(WHOLE)).drop(WHOLE)
    gathered = edges.groupBy("source", "chunk").applyInPandas(send, schema=LOG_SCHEMA)
    sent = inside.unionByName(gathered)
    # one cap over all sending tasks, in place or gathered
    return sent.coalesce(max_concurrency) if max_concurrency else sent


def send_paced(records: DataFrame, cfg: DeliveryConfig, transport=None, sleep=time.sleep,
               clock=time.time, max_concurrency: int | None = None) -> DataFrame:
    """POST the chunks of ``record_lines`` frames at one pace, ``cfg.max_rate`` requests
    a second over all tasks; returns the attempt log (lazy). Chunks of a file are dealt
    to the lanes in turn, so the lanes stay evenly filled whatever one file holds."""
    spark = records.sparkSession
    ship_package(spark)
    transport = transport or HttpTransport()
    # a lane without a running task would leave its slots unused
    lanes = max(1, min(max_concurrency or LANES, spark.sparkContext.defaultParallelism))
    columns = [f.name for f in LOG_SCHEMA.fields]

    def send(batches):
        paces: dict[int, Pace] = {}
        for source, chunk, lines, lane in _chunks(batches):
            pace = paces.setdefault(lane, Pace(lane, lanes, cfg.max_rate, sleep, clock))
            yield pd.DataFrame(post_chunk(lines, chunk, cfg, transport, sleep, source, pace.wait, clock),
                               columns=columns)

    lane = F.pmod(F.pmod(F.xxhash64("source"), F.lit(lanes)) + F.col("chunk"), F.lit(lanes)).cast("int")
    return records.select("source", "chunk", "idx", "line", lane.alias(LANE)) \
        .repartitionById(lanes, F.col(LANE)) \
        .sortWithinPartitions("chunk", "source", "idx") \
        .mapInPandas(send, schema=LOG_SCHEMA)


def deliver_file(spark, path: str, cfg: DeliveryConfig, transport=None, sleep=time.sleep,
                 lines: bool = True) -> DataFrame:
    """POST one finished file as a single request, from an executor; returns the
    attempt log (lazy). The body streams from the file in blocks, whatever its size.
    ``lines``: one record per line (else n_rows is null)."""
    from ferry.sinks.assemble import open_file
    from ferry.sources.cloud import store_options
    ship_package(spark)
    options = store_options(spark, path)
    transport = transport or HttpTransport()
    columns = [f.name for f in LOG_SCHEMA.fields]

    def send(batches):
        for pdf in batches:
            for target in pdf["path"]:
                with open_file(target, "rb", options) as src:
                    src.seek(0, 2)
                    body = FileBody(target, src.tell(), options)
                n = sum(block.count(b"\n") for block in body.blocks()) if lines else None
                rows = post_body(body, n, target.rsplit("/", 1)[-1], 0, cfg, transport, sleep, target)
                yield pd.DataFrame(rows, columns=columns)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(send, schema=LOG_SCHEMA)


def throughput(log: DataFrame) -> DataFrame:
    """Requests and records per second over delivered chunks."""
    ok = log.where(F.col("outcome") == "delivered")
    span = (F.max("ended_ms") - F.min("started_ms")) / F.lit(1000.0)
    return ok.agg(F.count(F.lit(1)).alias("requests"), F.sum("n_rows").alias("records"),
                  span.alias("seconds")) \
             .withColumn("req_per_sec", F.col("requests") / F.greatest(F.col("seconds"), F.lit(1e-3))) \
             .withColumn("rec_per_sec", F.col("records") / F.greatest(F.col("seconds"), F.lit(1e-3)))

"""Assemble one output file from ordered parts written in parallel.

Text outputs (CSV, TSV, NDJSON/JSON, raw lines, gzip or not) are valid when
their parts are concatenated byte for byte: concatenated gzip members are
one gzip stream. A plain CSV/TSV part carries its own header, dropped from
all but the first part while copying (so a single part is just renamed); a
gzip CSV gets the header once as its own first part.
So a single output file never needs a single task to *encode* all its rows.
Parquet parts give one file of all their row groups (``parquet_join``).
Spark tasks write the parts in parallel, and the file is then put together:

* with the file system's own ``concat`` where it has one (HDFS: a metadata
  operation, no bytes move);
* otherwise by a byte-stream copy in an executor task, one task per output
  file with a bounded buffer. Only names and byte counts come back.
"""

from __future__ import annotations

import uuid
from functools import partial

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ferry.session import local_path, ship_package
from ferry.sinks.commit import place
from ferry.sinks.fs import HadoopFS
from ferry.sinks.parquet_join import join_row_groups
from ferry.sources.cloud import open_in_store, store_options

COPY_BUFFER = 8 << 20
PLAN_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StringType())),
])
RESULT_SCHEMA = "target string, bytes long"


def _is_local(uri: str) -> bool:
    return uri.startswith("file:") or uri.startswith("/")


def open_file(uri: str, mode: str, options: dict):
    """A file on an executor: local, or through the store the driver described."""
    return open(local_path(uri), mode) if _is_local(uri) else open_in_store(uri, mode, options)


def _skip_header(src) -> bytes:
    """Read past the first record (up to a newline outside quotes); return what
    was read after it."""
    quotes = 0
    while True:
        buf = src.read(1 << 16)
        if not buf:
            return b""
        start = 0
        while True:
            nl = buf.find(b"\n", start)
            quotes += buf.count(b'"', start, nl if nl >= 0 else len(buf))
            if nl < 0:
                break
            if quotes % 2 == 0:
                return buf[nl + 1:]
            start = nl + 1


def _skip_through(src, marker: bytes) -> bytes:
    """Read past the first ``marker``; return what was read after it."""
    seen = b""
    while True:
        buf = src.read(1 << 16)
        if not buf:
            return b""
        seen += buf
        at = seen.find(marker)
        if at >= 0:
            return seen[at + len(marker):]


def _size_of(opened) -> int:
    """The length of a file opened for reading (positioned at its start again)."""
    opened.seek(0, 2)
    size = opened.tell()
    opened.seek(0)
    return size


def _joiner(options: dict | None):
    """Row-group join for one Parquet output per row of the plan."""
    def open_part(uri):
        src = open_file(uri, "rb", options)
        return src, _size_of(src)

    def join(batches):
        for pdf in batches:
            out = []
            for target, parts in zip(pdf["target"], pdf["parts"]):
                with open_file(target, "wb", options) as dst:
                    out.append((target, join_row_groups(dst, [partial(open_part, p) for p in parts], COPY_BUFFER)))
            yield pd.DataFrame(out, columns=["target", "bytes"])
    return join


def _copier(skip_repeated_header: bool, xml_root: str | None = None, options: dict | None = None):
    """Byte copier for one output per row of the plan.

    ``skip_repeated_header``: drop the first record of every part but the first.
    ``xml_root``: parts are whole XML documents; keep the head of the first
    and the ``</root>`` tail of the last, and strip both in between.
    """
    open_tag = f"<{xml_root}>\n".encode() if xml_root else b""
    close_tag = f"</{xml_root}>".encode() if xml_root else b""

    def copy_parts(batches):
        for pdf in batches:
            out = []
            for target, parts in zip(pdf["target"], pdf["parts"]):
                n = 0
                last = len(parts) - 1
                with open_file(target, "wb", options) as dst:
                    for i, p in enumerate(parts):
                        with open_file(p, "rb", options) as src:
                            held = b""
                            if i > 0 and skip_repeated_header:
                                held = _skip_header(src)
                            elif i > 0 and xml_root:
                                held = _skip_through(src, open_tag)
                            while True:
                                buf = src.read(COPY_BUFFER)
                                if not buf:
                                    break
                                held += buf
                                # keep a tail back until the end (it may be </root>)
                                keep = len(close_tag) + 8 if xml_root else 0
                                if len(held) > keep:
                                    cut = len(held) - keep
                                    dst.write(held[:cut])
                                    n += cut
                                    held = held[cut:]
                            if xml_root and i < last:
                                body = held.rstrip()
                                if body.endswith(close_tag):
                                    held = body[:-len(close_tag)]
                            dst.write(held)
                            n += len(held)
                out.append((target, n))
            yield pd.DataFrame(out, columns=["target", "bytes"])
    return copy_parts


CONCAT_SCHEMES = ("hdfs://", "viewfs://")


def _try_fs_concat(fs: HadoopFS, target: str, prefix: str | None, parts: list[str]) -> bool:
    """HDFS joins files with ``concat`` without moving bytes.

    HDFS wants the sources in the target's folder, so the parts are first
    renamed next to it (a metadata operation there); if ``concat`` fails
    they are put back and the byte copy runs instead.
    """
    if not target.startswith(CONCAT_SCHEMES) or not parts:
        return False
    folder, name = target.rsplit("/", 1)
    moved: list[tuple[str, str]] = []
    try:
        for i, p in enumerate(parts):
            near = f"{folder}/.{name}.part-{i:06d}"
            fs.rename(p, near)
            moved.append((p, near))
        sources = [near for _, near in moved]
        if prefix:  # a few header bytes, copied inside the JVM
            fs.copy_file(prefix, target)
        else:
            fs.rename(sources[0], target)
            sources = sources[1:]
        if sources:
            fs.concat(target, sources)
        return True
    except Exception:  # noqa: BLE001 - no concat here: restore and copy instead
        if fs.exists(target) and not prefix and moved and not fs.exists(moved[0][1]):
            fs.rename(target, moved[0][1])
        elif fs.exists(target):
            fs.delete(target, recursive=False)
        for original, near in moved:
            if fs.exists(near):
                fs.rename(near, original)
        return False


def join_parts(spark: SparkSession, plans: list[tuple[str, list[str]]],
               prefix: str | None = None, repeated_header: bool = False,
               xml_root: str | None = None, parquet: bool = False) -> list[tuple[str, str]]:
    """Make each output = ``prefix`` (shared, e.g. a CSV header) + its ``parts``, and
    give (finished file, target) for ``commit.place``.

    ``repeated_header``: every part starts with the same header line (plain
    CSV/TSV); it is kept from the first part only. A single part is finished.
    """
    fs = HadoopFS(spark)
    singles = [(parts[0], target) for target, parts in plans if len(parts) == 1 and not prefix]
    copies, swaps = [], []
    for target, parts in plans:
        if len(parts) == 1 and not prefix:
            continue
        # put together beside the target
        folder, name = target.rsplit("/", 1) if "/" in target else (".", target)
        beside = f"{folder}/.{name}.{uuid.uuid4().hex[:12]}"
        swaps.append((beside, target))
        if (repeated_header or xml_root or parquet
                or not _try_fs_concat(fs, fs.qualify(beside), prefix, parts)):
            copies.append((beside, ([prefix] if prefix else []) + list(parts)))
    if not copies:
        return singles + swaps
    ship_package(spark)
    options = store_options(spark, fs.qualify(copies[0][0]))
    plan_df = spark.createDataFrame(copies, PLAN_SCHEMA)
    plan_df = plan_df.repartition(min(len(copies), spark.sparkContext.defaultParallelism))
    try:
        join = _joiner(options) if parquet else _copier(repeated_header, xml_root, options)
        done = plan_df.mapInPandas(join, RESULT_SCHEMA).collect()
        if len(done) != len(copies):
            raise OSError("some outputs were not assembled")
    except Exception:
        for beside, _ in swaps:
            if fs.exists(beside):
                fs.delete(beside, recursive=False)
        raise
    return singles + swaps


def assemble(spark: SparkSession, plans: list[tuple[str, list[str]]], **how) -> None:
    """``join_parts``, and every output in its place."""
    place(HadoopFS(spark), join_parts(spark, plans, **how))


__all__ = ["assemble", "join_parts"]

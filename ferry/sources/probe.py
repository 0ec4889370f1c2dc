"""What a file holds, looked at before the Spark read to choose its options.

CSV header records and the first character of JSON files come from file heads
(after decompression), read on until the answer is found; Parquet columns come
from footers. A few files are looked at from the driver, concurrently through
Hadoop's FileSystem client; beyond ``DRIVER_FILES`` the tasks of one job do it, and
only a short answer per file comes back. XML children of the root are found by a
scan of the whole file, piece by piece (``readers.xml_shapes`` runs it on the executors).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from ferry.session import ship_package
from ferry.sinks.fs import HadoopFS

HEAD_BYTES = 65536
FIRST_LINE_BYTES = 4096


def heads(spark: SparkSession, paths: list[str], nbytes: int = HEAD_BYTES,
          threads: int | None = None) -> dict[str, bytes]:
    """Heads of many files, fetched concurrently (more threads for long
    lists: each fetch is mostly waiting on the store)."""
    fs = HadoopFS(spark)
    if len(paths) == 1:
        return {paths[0]: fs.read_head(paths[0], nbytes)}
    threads = threads or (16 if len(paths) <= 1000 else 64)
    with ThreadPoolExecutor(max_workers=min(threads, len(paths))) as pool:
        return dict(zip(paths, pool.map(lambda p: fs.read_head(p, nbytes), paths)))


def _until(fs: HadoopFS, path: str, found, nbytes: int):
    """``found(head, at_end)`` of a head that grows until it is not None: no
    limit on how far into a file the answer may lie."""
    while True:
        head = fs.read_head(path, nbytes)
        got = found(head, len(head) < nbytes)
        if got is not None:
            return got
        nbytes *= 16


# Up to this many files are looked at from the driver (no job needed).
DRIVER_FILES = 64


def _decompressed(src, path: str):
    low = path.lower()
    if low.endswith(".gz"):
        import gzip
        return gzip.GzipFile(fileobj=src)
    if low.endswith(".bz2"):
        import bz2
        return bz2.BZ2File(src)
    if low.endswith(".zst"):
        import zstandard
        return zstandard.ZstdDecompressor().stream_reader(src, read_across_frames=True)
    return src


def read_on(src, found, nbytes: int):
    """``found(head, at_end)`` of an open file, of a head that grows until it is not None."""
    head = b""
    while True:
        more = src.read(nbytes)
        head += more
        got = found(head, not more)
        if got is not None:
            return got
        nbytes = min(16 * nbytes, 1 << 24)


def in_tasks(spark: SparkSession, paths: list[str], answer) -> dict | None:
    """path -> ``answer(open file, path)`` (a string), found by the tasks of one job;
    None if executors cannot open files of that storage."""
    from ferry.sinks.assemble import open_file
    from ferry.sources.cloud import ASSEMBLED_SCHEMES, scheme_of, store_options
    if scheme_of(paths[0]) not in ASSEMBLED_SCHEMES:
        return None
    ship_package(spark)
    options = store_options(spark, paths[0])

    def look(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                with open_file(path, "rb", options) as src:
                    out.append((path, answer(src, path)))
            yield pd.DataFrame(out, columns=["path", "answer"])

    width = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(width) \
        .mapInPandas(look, "path string, answer string").collect()
    return {r.path: r.answer for r in rows}


def parquet_columns(src, path: str) -> str:
    """What a Parquet file says of its columns: Spark's own schema text, or Arrow's."""
    import pyarrow.parquet as pq
    meta = pq.ParquetFile(src).metadata
    own = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return own.decode() if own else str(meta.schema.to_arrow_schema().remove_metadata())


def _each(spark: SparkSession, paths: list[str], found, nbytes: int) -> dict:
    if len(paths) > DRIVER_FILES:
        many = in_tasks(spark, paths, lambda src, p: read_on(_decompressed(src, p), found, nbytes))
        if many is not None:
            return many
    fs = HadoopFS(spark)
    with ThreadPoolExecutor(max_workers=min(16 if len(paths) <= 1000 else 64, len(paths))) as pool:
        return dict(zip(paths, pool.map(lambda p: _until(fs, p, found, nbytes), paths)))


def header_records(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first record of each file, up to the first newline outside quotes."""
    return _each(spark, paths, header_record, FIRST_LINE_BYTES)


def header_record(head: bytes, at_end: bool) -> str | None:
    start = 0
    while True:
        end = head.find(b"\n", start)
        if end < 0:
            if not at_end:
                return None
            end = len(head)
        elif head.count(b'"', 0, end) % 2:
            start = end + 1        # inside quotes: part of a name
            continue
        return head[:end].decode("utf-8", errors="replace").removeprefix("\ufeff").rstrip("\r")


def first_chars(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first character of each file that is not blank."""
    return _each(spark, paths, lambda head, at_end: first_char(head) or ("" if at_end else None), 4096)


def first_char(head: bytes) -> str:
    text = head.decode("utf-8", errors="replace").lstrip("﻿ \t\r\n")
    return text[:1]


def xml_children(src, root: str | None, piece: int = 1 << 20) -> dict:
    """The row elements of a file, read from ``src`` (an open file) piece by piece.

    ``tags``: the child elements of the named root (or of the top element if there
    is none of that name), in order of appearance, each with its own children's
    names. ``plain``: its rows end exactly where the text ``</tag>`` stands (UTF-8, no
    comments, CDATA, instructions, document type, prefixes, rows without children or
    blanks in end tags). A child that also occurs deeper, inside another child,
    cannot be read by its tag alone and raises ``ValueError``; a file that is not
    well-formed raises ``SyntaxError``. Memory does not grow with the file.
    """
    import re
    from xml.parsers import expat

    parser = expat.ParserCreate(None, "}")
    path: list[str] = []
    walks: list[dict] = []
    odd = empty = False

    def oddity(*_):
        nonlocal odd
        odd = True

    def declared(_, encoding, __):
        if encoding and encoding.lower() not in ("utf-8", "us-ascii"):
            oddity()

    def start(name, attrs):
        nonlocal empty
        empty = False
        if "}" in name:
            oddity()
            name = name.rsplit("}", 1)[1]
        path.append(name)
        depth = len(path)
        if depth == 1:
            # below the top element, and (if that is another) below the named root
            walks.append({"root": None, "base": 1, "found": {}, "deeper": set()})
            if root and name != root:
                walks.append({"root": root, "base": None, "found": {}, "deeper": set()})
            return
        for w in walks:
            base = w["base"]
            if base is None:
                if name == w["root"]:
                    w["base"] = depth
            elif base == 0:
                w["deeper"].add(name)
            elif depth == base + 1:
                empty = True
                own = w["found"].setdefault(name, {})
                for k in attrs:
                    own["_" + ("{" + k if "}" in k else k)] = None
            elif depth > base:
                w["deeper"].add(name)
                if depth == base + 2:
                    w["found"].setdefault(path[base], {})[name] = None

    def end(_):
        if empty:
            oddity()
        path.pop()
        for w in walks:
            # the first root's parent ended: what follows is no row of that root
            if w["base"] and 0 < len(path) < w["base"] - 1:
                w["base"] = 0

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.XmlDeclHandler = declared
    parser.CommentHandler = parser.StartCdataSectionHandler = oddity
    parser.ProcessingInstructionHandler = parser.StartDoctypeDeclHandler = oddity
    blank_end, kept = re.compile(rb"</[^<>\s]+\s+>"), b""
    try:
        while True:
            more = src.read(piece)
            parser.Parse(more, not more)
            if not more:
                break
            if not odd and blank_end.search(kept + more):
                oddity()
            kept = (kept + more)[-1024:]
    except expat.ExpatError as e:
        raise SyntaxError(str(e)) from None
    picked = next((w for w in reversed(walks) if w["found"]), walks[0])
    found, deeper = picked["found"], picked["deeper"]
    both = sorted(set(found) & deeper)
    if both:
        raise ValueError(f"element <{both[0]}> stands directly under the root and deeper too: give xml_row_tag")
    return {"tags": {tag: list(fields) for tag, fields in found.items()}, "plain": not odd}

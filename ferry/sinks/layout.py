"""Output layouts: one merged file, one file per input, fixed-size chunks.

All are ordinary partitioned writes into a staging folder next to the
destination, followed by renames of the finished part files (names only
pass the driver; renames run in one batch on a small thread pool). The
destination is replaced only after the write succeeded.

* per input file: rows carry ``md5(source path)``; ``partitionBy`` on it
  gives one folder per input. When every input file is read by exactly one
  task (small or unsplittable files) no shuffle is needed.
* joinable formats (CSV, TSV, NDJSON, raw lines — gzip or not — plain XML
  and Parquet), fed by enough input: an output is assembled from parts written in
  parallel, in order, with no shuffle (per input split for a plain scan),
  by ``sinks.assemble`` — so no single task encodes a whole file, whether
  it is a merge of everything, one huge input, or a chunk; chunks inside
  one split are single parts (renamed).
* otherwise rows are hash-partitioned by (file[, chunk]) so one task
  writes each output; chunks have a fixed row count, so that is never
  skewed. Gzip XML single files have one writer task; upstream work stays
  parallel.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions.internal import CHUNK, FID, IDX, SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.functions.names import join
from ferry.session import conf_bytes
from ferry.sinks import writers
from ferry.sinks.assemble import CONCAT_SCHEMES, assemble, join_parts
from ferry.sinks.commit import OutputError, guard, place
from ferry.sinks.fs import HadoopFS
from ferry.sources.readers import literal
from ferry.sources.splits import one_task_per_file, split_bytes

# Outputs fed by less input than this are written by one task (no assembly
# jobs); above it, text outputs are assembled from parallel parts.
ASSEMBLE_MIN_BYTES_CONF = "spark.ferry.assembleMinBytes"
ASSEMBLE_MIN_BYTES = 8 << 20


@dataclass(frozen=True)
class Written:
    source: str | None
    chunk: int | None
    path: str


@contextmanager
def _staging(fs: HadoopFS, out_dir: str):
    """A fresh hidden folder next to the outputs, as a qualified path (its
    scheme tells which file system the outputs are assembled on). It goes in
    the end, also after a failure."""
    fs.mkdirs(out_dir)
    stage = fs.qualify(join(out_dir, f".ferry-staging-{uuid.uuid4().hex[:12]}"))
    try:
        yield stage
    finally:
        fs.delete(stage)


def _part_files(fs: HadoopFS, folder: str, fmt: str | None = None) -> list[str]:
    """Part files in order. Spark writes a part of length 0 where the first partition
    has no rows; in XML the file's head would be taken from it, so there it is left out."""
    return sorted(f.path for f in fs.list(folder)
                  if not f.is_dir and f.path.rsplit("/", 1)[-1].startswith("part-")
                  and (f.length or fmt != "xml"))


def is_globally_sorted(df: DataFrame) -> bool:
    """True when the plan ends in a global sort (under projections/limits).

    Used so a merged write keeps a user's ORDER BY (``coalesce(1)`` keeps
    partition order) without collapsing unordered upstream work into one task.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = node.getClass().getSimpleName()
        if name == "Sort":
            return bool(getattr(node, "global")())
        if name in ("Project", "GlobalLimit", "LocalLimit", "Filter", "SubqueryAlias"):
            node = node.child()
            continue
        return False


def _parts_in(fs: HadoopFS, folder: str) -> list[str]:
    """Part files under ``folder`` in order: by ``_src_block=`` value, then part number."""
    out = []
    entries = fs.list(folder)
    for f in sorted((e for e in entries if e.is_dir and f"/{SRC_BLOCK}=" in e.path),
                    key=lambda e: int(e.path.rsplit("=", 1)[1])):
        out += _part_files(fs, f.path)
    return out + _part_files(fs, folder)


def _header_in_parts(fmt: str, compressed: bool, where: str = "") -> bool:
    """Plain CSV/TSV parts keep their own header line (dropped when joined).

    Not on HDFS: there a separate header part lets ``concat`` join the
    parts without moving bytes (header stripping would need a copy).
    """
    return (fmt in ("csv", "tsv") and not compressed
            and not where.startswith(CONCAT_SCHEMES))


def _header_part(df: DataFrame, fmt: str, compressed: bool, stage: str) -> str | None:
    """Gzip CSV/TSV header as its own small file (Spark's writer quotes the names)."""
    if fmt not in ("csv", "tsv") or _header_in_parts(fmt, compressed, stage):
        return None
    fs = HadoopFS(df.sparkSession)
    empty = df.sparkSession.createDataFrame([], df.schema).coalesce(1)
    folder = join(stage, "_header")
    writers.writer(empty, fmt, compressed).save(folder)
    return _part_files(fs, folder)[0]


def _header_only(df: DataFrame, fmt: str, stage: str, xml_root: str = "root",
                 xml_row: str = "row", compressed: bool = False) -> str:
    """What the writer makes of no rows (CSV header, Parquet schema, empty file)."""
    fs = HadoopFS(df.sparkSession)
    folder = join(stage, "_empty")
    empty = df.sparkSession.createDataFrame([], df.schema).coalesce(1)
    if fmt == "xml":     # Spark's XML writer writes nothing for no rows
        text = f"<{xml_root}>\n</{xml_root}>"
        empty = df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
        empty.write.text(folder, compression="gzip" if compressed else "none")
    else:
        writers.writer(empty, fmt, compressed, xml_root=xml_root, xml_row=xml_row).save(folder)
    return _part_files(fs, folder)[0]


def _empty_outputs(data: DataFrame, fmt: str, compressed: bool, stage: str, targets: list[str],
                   xml_root: str, xml_row: str) -> list[tuple[str, str]]:
    """(finished file, target) of outputs without rows (inputs none of whose rows are left)."""
    if not targets:
        return []
    fs = HadoopFS(data.sparkSession)
    hidden = [c for c in (FID, CHUNK, IDX, SRC_BLOCK) if c in data.columns]
    model = _header_only(data.drop(*hidden), fmt, stage, xml_root, xml_row, compressed)
    ready = [(join(stage, f"_empty-{i}"), t) for i, t in enumerate(targets)]
    for own, _ in ready:
        fs.copy_file(model, own)
    return ready


def write_bare(spark: SparkSession, fmt: str, targets: list[str], stage_root: str, compressed: bool,
               xml_root: str, protected: list[str]) -> list[str]:
    """Outputs of inputs of length 0, which have neither rows nor columns: empty text
    files, an empty XML root. Parquet cannot hold no columns: none is written."""
    if fmt == "parquet" or not targets:
        return []
    fs = HadoopFS(spark)
    body = f"<{xml_root}>\n</{xml_root}>".encode() if fmt == "xml" else b""
    with _staging(fs, stage_root) as stage:
        swaps = []
        for i, target in enumerate(targets):
            fs.write_bytes(join(stage, f"bare-{i}"), gzip.compress(body) if compressed else body)
            swaps.append((join(stage, f"bare-{i}"), target))
        place(fs, swaps, protected)
    return targets


def _single_from_parts(df: DataFrame, fmt: str, target: str, stage: str, compressed: bool,
                       preserve_order: bool, xml_root: str = "root",
                       xml_row: str = "row") -> Written:
    """Parallel ordered parts, then one file by concatenation (of bytes, or row groups)."""
    spark = df.sparkSession
    fs = HadoopFS(spark)
    tagged = all(c in df.columns for c in (SRC_FILE, SRC_BLOCK, SRC_POS))
    if tagged and preserve_order:
        encoded = df.inputFiles()
        keyed = (df.withColumn(FID, F.md5(F.col(SRC_FILE)))
                 .sortWithinPartitions(FID, SRC_BLOCK, SRC_POS))
        data = writers.prepare(keyed, fmt, keep=(SRC_BLOCK,))
        header = _header_part(data.drop(FID, SRC_BLOCK), fmt, compressed, stage)
        writers.writer(data, fmt, compressed, xml_root, xml_row,
                       header=_header_in_parts(fmt, compressed, stage)) \
            .partitionBy(FID, SRC_BLOCK).save(join(stage, "parts"))
        by_key = {source_key(fs.uri_form(e)): e for e in encoded}
        dirs = [d for d in fs.list(join(stage, "parts")) if d.is_dir and f"/{FID}=" in d.path]
        dirs.sort(key=lambda d: by_key.get(d.path.rsplit("=", 1)[1], d.path))
        parts = [p for d in dirs for p in _parts_in(fs, d.path)]
    else:
        ordered = df.orderBy(IDX) if IDX in df.columns and preserve_order else df
        data = writers.prepare(ordered.drop(IDX) if IDX in ordered.columns else ordered, fmt)
        header = _header_part(data, fmt, compressed, stage)
        writers.writer(data, fmt, compressed, xml_root, xml_row,
                       header=_header_in_parts(fmt, compressed, stage)).save(join(stage, "parts"))
        # part numbers follow partition order, which is the sort order when sorted
        parts = _part_files(fs, join(stage, "parts"), fmt)
    if not parts and not header:
        # no rows at all: a header-only CSV, an empty root element, an empty file
        parts = [_header_only(data.drop(*[c for c in (FID, SRC_BLOCK) if c in data.columns]),
                              fmt, stage, xml_root, xml_row, compressed)]
    assemble(spark, [(target, parts)], prefix=header,
             repeated_header=_header_in_parts(fmt, compressed, stage),
             xml_root=xml_root if fmt == "xml" else None, parquet=fmt == "parquet")
    return Written(None, None, target)


PARTITION_BYTES = 128 << 20


def target_partitions(spark: SparkSession, input_bytes: int) -> int:
    """Shuffle width for a repartition: ~128 MiB of input per partition, at
    least the configured shuffle partitions (AQE may still coalesce)."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(base, -(-int(input_bytes) // PARTITION_BYTES))


def assemble_min_bytes(spark: SparkSession) -> int:
    return conf_bytes(spark, ASSEMBLE_MIN_BYTES_CONF, ASSEMBLE_MIN_BYTES)


def write_single(df: DataFrame, fmt: str, target: str, compressed: bool = False,
                 xml_root: str = "root", xml_row: str = "row",
                 preserve_order: bool = True, input_bytes: int | None = None) -> Written:
    """Write everything to one file at ``target`` (replacing it).

    Joinable formats fed by large inputs (``input_bytes`` ≥ the assemble
    threshold; unknown counts as large) are assembled from parts written in
    parallel; gzip XML (root tags inside the members) and small outputs have
    one writer task.
    """
    large = input_bytes is None or input_bytes >= assemble_min_bytes(df.sparkSession)
    fs = HadoopFS(df.sparkSession)
    with _staging(fs, target.rsplit("/", 1)[0] if "/" in target else ".") as stage:
        if writers.joinable(fmt, compressed, stage) and large:
            return _single_from_parts(df, fmt, target, stage, compressed, preserve_order,
                                      xml_root, xml_row)
        return _single_from_one(df, fmt, target, stage, compressed, preserve_order,
                                xml_root, xml_row, large)


def _single_from_one(df: DataFrame, fmt: str, target: str, stage: str, compressed: bool,
                     preserve_order: bool, xml_root: str, xml_row: str, large: bool) -> Written:
    fs = HadoopFS(df.sparkSession)
    tagged = all(c in df.columns for c in (SRC_FILE, SRC_BLOCK, SRC_POS))
    if tagged and preserve_order and not large:
        # small input: one task reads it all and sorts locally, no shuffle
        one = df.coalesce(1).sortWithinPartitions(SRC_FILE, SRC_BLOCK, SRC_POS)
    elif tagged and preserve_order:
        one = df.orderBy(SRC_FILE, SRC_BLOCK, SRC_POS).coalesce(1)
    elif IDX in df.columns and preserve_order:
        one = df.orderBy(IDX).coalesce(1)
    elif is_globally_sorted(df):
        one = df.coalesce(1)
    else:
        one = df.repartition(1)
    data = writers.prepare(one.drop(IDX) if IDX in one.columns else one, fmt)
    writers.writer(data, fmt, compressed, xml_root, xml_row).save(stage)
    parts = _part_files(fs, stage)
    if len(parts) != 1:
        raise OutputError(f"expected one part file in {stage}, found {len(parts)}")
    place(fs, [(parts[0], target)])
    return Written(None, None, target)


def source_key(encoded_path: str) -> str:
    """Same value as Spark's ``md5(_metadata.file_path)`` for that file."""
    return hashlib.md5(encoded_path.encode("utf-8")).hexdigest()


# Spark keeps up to this many part files of one task open at a time. A task
# that writes no more outputs than that needs no sort by output: rows go to
# their files as they come, which is scan order.
OPEN_WRITERS = 256
OPEN_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"


def in_scan_order(spark: SparkSession, sizes: list[int]) -> bool:
    """Do the tasks of a scan of these files stay below OPEN_WRITERS outputs?

    A task is packed with files up to the split size, each counted with the
    open cost at least.
    """
    open_cost = conf_bytes(spark, "spark.sql.files.openCostInBytes", 4 << 20)
    return split_bytes(spark, sizes) // max(1, open_cost) + 1 < OPEN_WRITERS


@contextmanager
def unsorted_writes(spark: SparkSession, on: bool = True):
    before = spark.conf.get(OPEN_WRITERS_CONF, "0")
    if on:
        spark.conf.set(OPEN_WRITERS_CONF, str(OPEN_WRITERS))
    try:
        yield
    finally:
        spark.conf.set(OPEN_WRITERS_CONF, before)


# Up to this many output folders are listed with direct file-system calls;
# beyond it Spark's file index lists them in one job.
DIRECT_LISTING_MAX = 64


def _leaf_parts(spark: SparkSession, folder: str,
                expected: int | None = None) -> list[tuple[dict, str]]:
    """Part files under a ``partitionBy`` folder, with their partition values.

    Many outputs (or an unknown number, e.g. chunks) are listed by Spark's
    own file index (parallel for big trees; the content column is pruned):
    one small job, not a file-system call per folder. A few are listed
    directly. Only names reach the driver.
    """
    if expected is not None and expected <= DIRECT_LISTING_MAX:
        fs = HadoopFS(spark)
        paths, todo = [], [folder]
        while todo:
            for entry in fs.list(todo.pop()):
                if entry.is_dir:
                    todo.append(entry.path)
                else:
                    paths.append(entry.path)
    else:
        listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                   .load(literal(folder)).select("path"))
        paths = [r.path for r in listing.collect()]
    out = []
    for path in paths:
        segments = path.split("/")
        if not segments[-1].startswith("part-"):
            continue
        values = dict(seg.split("=", 1) for seg in segments[:-1]
                      if seg.startswith((f"{FID}=", f"{CHUNK}=", f"{SRC_BLOCK}=")))
        out.append((values, path))
    return out


def write_per_source(df: DataFrame, fmt: str, stage_root: str, dest_for, sizes: list[int],
                     splittable: bool, compressed: bool = False, chunked: bool = False,
                     xml_root: str = "root", xml_row: str = "row",
                     inputs: list[str] | None = None,
                     protected: list[str] | None = None) -> list[Written]:
    """One output per input file (and per chunk when ``chunked``).

    ``dest_for(source_path, chunk_number_or_None)`` gives the output path;
    outputs may go to different folders. The staging folder is made under
    ``stage_root`` (one write, whatever the number of destination folders).
    ``df`` must carry the source file column (and ``_idx``/``_chunk`` when
    chunked). ``inputs`` are the input files as Spark names them
    (``DataFrame.inputFiles()`` of the scan), needed when ``df`` was
    checkpointed on the way. ``protected``: every input of the job (paths).

    Layouts, cheapest first:

    * every file read whole by one task: ``partitionBy(file)``, no shuffle;
    * text output of a plain scan: parts per (file[, chunk], split), no
      shuffle; an output made of several parts is joined in split order
      (for chunks only those that cross a split boundary);
    * otherwise rows are hash-partitioned by (file[, chunk]) so one task
      writes each output: chunks are N rows each, so that is never skewed.
    """
    with _staging(HadoopFS(df.sparkSession), stage_root) as stage:
        return _write_per_source(df, fmt, stage, dest_for, sizes, splittable, compressed, chunked,
                                 xml_root, xml_row, inputs, protected)


def _write_per_source(df: DataFrame, fmt: str, stage: str, dest_for, sizes: list[int],
                      splittable: bool, compressed: bool, chunked: bool, xml_root: str, xml_row: str,
                      inputs: list[str] | None, protected: list[str] | None) -> list[Written]:
    spark = df.sparkSession
    encoded = inputs if inputs is not None else df.inputFiles()
    keyed = df.withColumn(FID, F.md5(F.col(SRC_FILE)))
    direct_scan = all(c in df.columns for c in (SRC_BLOCK, SRC_POS))
    whole_files = direct_scan and one_task_per_file(spark, sizes, splittable)
    large = sum(sizes) >= assemble_min_bytes(spark)
    parted = writers.joinable(fmt, compressed, stage)
    # chunks of tagged rows of a large input: parts per (file, chunk, split)
    # need no shuffle, and a chunk inside one split is a single part (a
    # rename) — unless every chunk would need a separate header part copied
    # in front (gzip CSV). Small inputs sit in few tasks: the shuffle spreads
    # the encoding wider.
    chunk_parts = (chunked and direct_scan and large
                   and not (fmt in ("csv", "tsv") and compressed))
    single_parts = not chunked and not whole_files and large
    if parted and (chunk_parts or single_parts):
        return _per_source_from_parts(keyed, fmt, stage, dest_for, compressed, encoded,
                                      direct_scan, chunked, xml_root, xml_row,
                                      as_scanned=direct_scan and not chunked and in_scan_order(spark, sizes),
                                      protected=protected)
    parts = [FID, CHUNK] if chunked else [FID]
    order = [FID] + ([CHUNK, IDX] if chunked else
                     ([SRC_BLOCK, SRC_POS] if direct_scan else []))
    as_scanned = not chunked and whole_files and in_scan_order(spark, sizes)
    if chunked or not whole_files:
        keyed = keyed.repartition(target_partitions(spark, sum(sizes)),
                                  *[F.col(c) for c in parts])
    if not as_scanned:
        keyed = keyed.sortWithinPartitions(*order)
    data = writers.prepare(keyed.drop(*[c for c in (IDX,) if c in keyed.columns]), fmt)
    fs = HadoopFS(spark)
    with unsorted_writes(spark, as_scanned):
        writers.writer(data, fmt, compressed, xml_root, xml_row).partitionBy(*parts).save(stage)
    leaves = _leaf_parts(spark, stage, None if chunked else len(sizes))
    return _place(spark, fs, stage, leaves, encoded, dest_for, chunked,
                  None, False, joinable=False, empty=(data, fmt, compressed, xml_root, xml_row),
                  protected=protected)


def _place(spark: SparkSession, fs: HadoopFS, stage: str, leaves: list, encoded: list[str],
           dest_for, chunked: bool, header: str | None, repeated_header: bool,
           joinable: bool = True, xml_root: str | None = None, empty: tuple = (), fmt: str | None = None,
           protected: list[str] | None = None) -> list[Written]:
    """Group part files by output, order them by split, move or join them.

    ``joinable=False``: each output must be exactly one part (one writer task).
    An input without rows gets an output without rows (``empty``: the written
    DataFrame, format, compression and XML names); chunks of an earlier run
    behind the last one of this run go. All outputs are swapped in together;
    one that would replace a file of ``protected`` stops the job before that.
    """
    by_key = {source_key(fs.uri_form(e)): fs.uri_to_path(e) for e in encoded}
    groups: dict[tuple, list] = {}
    for values, path in leaves:
        key = (values[FID], int(values[CHUNK]) if chunked else None)
        groups.setdefault(key, []).append((int(values.get(SRC_BLOCK, 0)), path))
    plans, written = [], []
    for (fid, chunk), items in groups.items():
        source = by_key.get(fid)
        if source is None:
            raise OutputError(f"no input file for output key {fid}")
        dst = dest_for(source, None if chunk is None else chunk + 1)
        if not joinable and len(items) != 1:
            raise OutputError(f"expected one part file for {dst}, found {len(items)}")
        plans.append((dst, [p for _, p in sorted(items)]))
        written.append(Written(source, chunk, dst))
    sources = list(by_key.values())
    guard(fs, protected or sources, [t for t, _ in plans])
    swaps = join_parts(spark, plans, prefix=header, repeated_header=repeated_header, xml_root=xml_root,
                       parquet=fmt == "parquet")
    if chunked:
        place(fs, swaps, protected or sources, chunks={w.path: (w.source, w.chunk + 1) for w in written},
              sources=sources, also=[dest_for(s, 1).rsplit("/", 1)[0] for s in sources])
    else:
        done = {w.source for w in written}
        bare = [s for s in sources if s not in done] if empty else []
        if bare:
            data, fmt, compressed, root, row = empty
            swaps += _empty_outputs(data, fmt, compressed, stage, [dest_for(s, None) for s in bare], root, row)
            written += [Written(s, None, dest_for(s, None)) for s in bare]
        place(fs, swaps, protected or sources)
    return sorted(written, key=lambda w: (w.source or "", w.chunk or 0))


def _per_source_from_parts(keyed: DataFrame, fmt: str, stage: str, dest_for,
                           compressed: bool, encoded: list[str], direct_scan: bool,
                           chunked: bool = False, xml_root: str = "root",
                           xml_row: str = "row", as_scanned: bool = False,
                           protected: list[str] | None = None) -> list[Written]:
    """One output per input (or chunk) without a shuffle: every task writes
    its slice of each output as a part — per input split for a plain scan, so
    parts follow file order — and each output is its parts joined in order."""
    spark = keyed.sparkSession
    fs = HadoopFS(spark)
    block = [SRC_BLOCK] if direct_scan else []
    chunk = [CHUNK] if chunked else []
    ordered = keyed if as_scanned else keyed.sortWithinPartitions(
        FID, *chunk, *([SRC_BLOCK, SRC_POS] if direct_scan else []))
    ordered = ordered.drop(*[c for c in (IDX,) if c in ordered.columns])
    data = writers.prepare(ordered, fmt, keep=tuple(block))
    header = _header_part(data.drop(FID, *chunk, *block), fmt, compressed, stage)
    with unsorted_writes(spark, as_scanned):
        writers.writer(data, fmt, compressed, xml_root, xml_row,
                       header=_header_in_parts(fmt, compressed, stage)) \
            .partitionBy(FID, *chunk, *block).save(join(stage, "parts"))
    # per-split folders grow with the data: list those with Spark
    leaves = _leaf_parts(spark, join(stage, "parts"),
                         None if chunked or direct_scan else len(encoded))
    return _place(spark, fs, stage, leaves, encoded, dest_for, chunked, header,
                  _header_in_parts(fmt, compressed, stage), xml_root=xml_root if fmt == "xml" else None, fmt=fmt,
                  empty=(data, fmt, compressed, xml_root, xml_row),
                  protected=protected)

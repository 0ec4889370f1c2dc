"""Run a Job: catalogue → read → stages → sink, all as Spark jobs.

Stage order: scan → (columns + dedupe) or SQL → reshaping steps → sink.
Modes:

* analytical (SQL or count, no output format): all files as one relation;
  the query runs once into a scratch table, from which ``query_result.csv``
  is written and which ``JobResult.result`` reads.
* preview: first N rows of the first file, nothing written.
* merged (``single_file``): all files as one relation → one output file.
* per file (default): one output per input file (or per chunk of N rows,
  numbered from 1 in file order), optionally POSTed in chunks. This is one
  Spark job over all files, also with row-local SQL (projections and
  filters, whose per-file result is the global result split by file). Other
  SQL (aggregates, sorts, limits, joins, windows) is per file by definition,
  so those files are submitted as concurrent Spark jobs.
"""

from __future__ import annotations

import dataclasses
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions import names
from ferry.functions.internal import SOURCE_COLS, SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.functions.sqltext import prepare_sql
from ferry.functions.formats import (JSON_FORMATS, compression_of, file_format,
                                     output_extension)
from ferry.operators import chunking, project
from ferry.operators.preview import preview as preview_rows
from ferry.operators.report import count_lines
from ferry.operators.sqlstage import read_sql_text, run_sql, run_sql_as
from ferry.operators.transform import apply_steps, as_chain
from ferry.plans.job import Job, JobError
from ferry.session import conf_bytes, job_session, scratch_path
from ferry.sinks import layout, writers
from ferry.sinks.fs import HadoopFS
from ferry.sources.catalogue import Catalogue, CatalogueError, find_input_files
from ferry.sources.cloud import ASSEMBLED_SCHEMES, apply_credentials, scheme_of
from ferry.sources.readers import ReadOptions, read_files, schema_groups
from ferry.streaming.delivery import MAX_RATE, DeliveryConfig, deliver_file, record_lines, send_paced

log = logging.getLogger("ferry")

COUNT_SQL = "SELECT COUNT(*) as count FROM input_data"


@dataclass
class JobResult:
    mode: str
    outputs: list = field(default_factory=list)
    result: DataFrame | None = None
    delivery_log: DataFrame | None = None
    warnings: list = field(default_factory=list)
    transformed: bool = True

    def show(self, n: int = 20) -> None:
        """Print the analytical result or preview as a table (first ``n`` rows)."""
        if self.result is not None:
            self.result.show(n, truncate=False)


def _read_options(job: Job, fast: bool) -> ReadOptions:
    return ReadOptions(xml_root=job.xml_root, fast=fast, csv_multiline=job.csv_multiline,
                       schema=job.schema)


def _read(js, files, job: Job, fast: bool, tag: bool = False,
          one_header: bool = False) -> DataFrame:
    """Read catalogue entries (``FileInfo``) with the job's options."""
    opts = dataclasses.replace(_read_options(job, fast), sizes=tuple(f.length for f in files))
    if one_header:
        opts = dataclasses.replace(opts, csv_one_header=True)
    return read_files(js, [f.path for f in files], opts, tag=tag)


def _fast_lines(job: Job, cat: Catalogue) -> bool:
    """Fast mode reads raw lines when the input is JSON lines and the output JSON."""
    if not job.fast_mode:
        return False
    in_json = cat.first_format() in JSON_FORMATS
    return in_json and (job.analytical or job.out_format in JSON_FORMATS)


def stages(df: DataFrame, job: Job, sql_text: str | None, per_file: bool) -> tuple[DataFrame, bool]:
    """Apply (cols + dedupe) or SQL, then steps. Returns (df, still_in_scan_order)."""
    in_order = True
    if sql_text:
        df = run_sql(df, sql_text)
        in_order = False
    else:
        df = project.select_columns(df, job.cols)
        if job.dedupe:
            df = project.dedupe(df, None, per_file=per_file)
            in_order = False
    df, applied = apply_steps(df, job.steps, strict=job.strict)
    return df, in_order


def read_files_whole(js: SparkSession, sizes: list[int]) -> None:
    """One task per input file, never a split of one (this job's session).

    For outputs that need a single writer per input (Parquet, gzip XML),
    reading each file whole lets that writer stream it — no shuffle, no
    sort — while different files still run in parallel. With both settings
    at the largest file size, Spark neither cuts a file nor packs two into
    one task.
    """
    biggest = max(sizes, default=0) + 1
    if biggest > conf_bytes(js, "spark.sql.files.maxPartitionBytes", 128 << 20):
        js.conf.set("spark.sql.files.maxPartitionBytes", str(biggest))
        js.conf.set("spark.sql.files.openCostInBytes", str(biggest))


def size_shuffles(js: SparkSession, input_bytes: int) -> None:
    """Shuffle width for this job's session: ~128 MiB of input per partition,
    never below the configured value; AQE coalesces what turns out small."""
    js.conf.set("spark.sql.shuffle.partitions",
                str(layout.target_partitions(js, input_bytes)))


def _guard(fs: HadoopFS, inputs: list[str], outputs: list[str]) -> None:
    """Refuse any output that would overwrite an input (local and cloud)."""
    qin = {fs.qualify(p) for p in inputs}
    for o in outputs:
        if fs.qualify(o) in qin:
            raise JobError(f"{o} is an input of this job and cannot be its output")


def run(spark: SparkSession, job: Job, transport=None, sleep=None) -> JobResult:
    job = job.validated()
    js = job_session(spark)
    apply_credentials(js, job.credentials, tuple(p for p in (job.input, job.output) if p))
    if job.output and job.preview == 0 and job.out_format != "parquet" and writers.joinable(
            job.out_format or "csv", job.compressed):
        if scheme_of(job.output) not in ASSEMBLED_SCHEMES:
            # before any work: text outputs there could not be put together at the end
            raise JobError(f"{job.output}: text outputs need a local, HDFS, S3 or Google storage path")
    for w in job.warnings:
        log.warning(w)
    try:
        cat = find_input_files(js, job.input)
    except CatalogueError as e:
        raise JobError(str(e)) from e
    if not cat.files and (job.analytical or job.preview > 0 or job.single_file):
        raise JobError(f"{job.input}: all data files are empty")
    size_shuffles(js, cat.total_bytes)
    sql_text = read_sql_text(js, job.sql) if job.sql else None
    if job.count:
        sql_text = COUNT_SQL
    if job.verbose:
        # the job (its repr leaves credentials out) and the SQL as it will run
        log.warning("job: %r", job)
        if sql_text:
            log.warning("sql: %s", prepare_sql(sql_text))
    if job.analytical:
        return _run_analytical(js, job, cat, sql_text)
    if job.preview > 0:
        return _run_preview(js, job, cat, sql_text)
    if job.single_file:
        return _run_merged(js, job, cat, sql_text, transport, sleep)
    return _run_per_file(js, job, cat, sql_text, transport, sleep)


def _run_analytical(js, job: Job, cat: Catalogue, sql_text: str) -> JobResult:
    cat.check_same_format()
    fast = _fast_lines(job, cat)
    if job.count and fast:
        result = count_lines(js, cat.paths)
    else:
        df = _read(js, cat.files, job, fast)
        result = run_sql(df, sql_text)
    out_dir = job.output or "."
    name = "query_result.csv"
    if job.prefix or job.suffix:
        name = names.build_output_filename("query_result", "csv", job.prefix, job.suffix)
    target = names.join(out_dir, name)
    _guard(HadoopFS(js), cat.paths, [target])
    result = _once(js, result)
    written = layout.write_single(result, "csv", target, input_bytes=cat.total_bytes)
    return JobResult("analytical", [written], result, warnings=list(job.warnings))


def _once(js, df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once: an ordered result keeps its order
    through a row number, names that Parquet cannot hold through positions."""
    names_ = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names_))])
    path = scratch_path(js, "result")
    ordered = layout.is_globally_sorted(df)
    if ordered:
        plain = plain.select("*", F.monotonically_increasing_id().alias("at"))
    plain.write.parquet(path)
    back = js.read.schema(plain.schema).parquet(path)
    if ordered:
        back = back.orderBy("at").drop("at")
    return back.toDF(*names_)


def _run_preview(js, job: Job, cat: Catalogue, sql_text: str | None) -> JobResult:
    fast = _fast_lines(job, cat)
    df = _read(js, cat.files[:1], job, fast)
    if sql_text:
        df = run_sql(df, sql_text)
    else:
        df = project.select_columns(df, job.cols)
        if job.dedupe:
            df = project.dedupe(df)
    steps = job.steps if job.out_format in JSON_FORMATS else None
    return JobResult("preview", [], preview_rows(df, job.preview, steps),
                     warnings=list(job.warnings))


def _merged_target(fs: HadoopFS, job: Job, cat: Catalogue, ext: str) -> str:
    if job.output and names.looks_like_file(job.output) and not fs.is_dir(job.output):
        target = job.output
    else:
        if job.output:
            out_dir = job.output
        elif cat.is_dir:
            out_dir = names.default_output_dir(cat.root, True)
        else:
            out_dir = names.default_output_dir(cat.root, False)
        if job.single_file_name:
            target = names.join(out_dir, job.single_file_name)
        else:
            target = names.join(out_dir, names.merged_filename(
                cat.root, cat.is_dir, ext, job.prefix, job.suffix, compressed=False))
    if job.compressed and not target.endswith(".gz"):
        target += ".gz"
    return target


def _run_merged(js, job: Job, cat: Catalogue, sql_text: str | None,
                transport=None, sleep=None) -> JobResult:
    fmt = job.out_format
    cat.check_same_format()
    fs = HadoopFS(js)
    fast = _fast_lines(job, cat)
    df = _read(js, cat.files, job, fast, tag=True)
    df, _ = stages(df, job, sql_text, per_file=False)
    chain = as_chain(job.steps)
    sink_fmt = "lines" if fast or (chain and chain.raw_lines) else fmt
    target = _merged_target(fs, job, cat, output_extension(fmt))
    _guard(fs, cat.paths, [target])
    written = layout.write_single(df, sink_fmt, target, job.compressed, job.xml_root,
                                  input_bytes=cat.total_bytes)
    result = JobResult("merged", [written], warnings=list(job.warnings))
    if job.url:
        cfg = DeliveryConfig(url=job.url, headers=tuple(job.headers))
        more = {} if sleep is None else {"sleep": sleep}
        sent = deliver_file(js, fs.qualify(target), cfg, transport,
                            lines=sink_fmt in (*JSON_FORMATS, "lines") and not job.compressed, **more)
        result.delivery_log = _write_log(js, job, sent)
    return result


def _splittable(kind_ext: str, paths: list[str], fast: bool) -> bool:
    """Can Spark cut one of these files into several splits?"""
    if any(compression_of(p) in ("gz", "zst") for p in paths):
        return False
    if fast:
        return True
    return kind_ext in ("parquet", "ndjson", "jsonl", "json", "xml", "csv", "tsv")


def _run_per_file(js, job: Job, cat: Catalogue, sql_text: str | None,
                  transport=None, sleep=None) -> JobResult:
    fmt = job.out_format
    ext = output_extension(fmt)
    fs = HadoopFS(js)
    out_dir_for = (lambda src: job.output) if job.output else \
        (lambda src: src.rsplit("/", 1)[0])
    chain = as_chain(job.steps)
    fast = _fast_lines(job, cat)
    sink_fmt = "lines" if fast or (chain and chain.raw_lines) else fmt

    def name_for(src: str, chunk: int | None) -> str:
        base = names.output_base_name(src)
        if chunk is None:
            return names.build_output_filename(base, ext, job.prefix, job.suffix, job.compressed)
        return names.chunk_filename(base, chunk, ext, job.prefix, job.suffix, job.compressed)

    every = [f.path for f in (*cat.files, *cat.empty)]
    planned = [names.join(out_dir_for(p), name_for(p, None)) for p in every]
    seen: dict[str, list[str]] = {}
    for src, dst in zip(every, planned):
        seen.setdefault(dst, []).append(src)
    clashes = [v for v in seen.values() if len(v) > 1]
    if clashes:
        pairs = "; ".join(", ".join(v) for v in clashes)
        raise JobError(f"inputs whose outputs would have one name: {pairs}")
    if job.rows == 0:      # names of chunks are checked when their number is known
        _guard(fs, every, planned)

    # One Spark job per input format (usually one), whatever the folders.
    stage_root = job.output or (cat.root.rstrip("/") if cat.is_dir
                                else names.default_output_dir(cat.root, False))

    def dest_for(src: str, chunk: int | None) -> str:
        return names.join(out_dir_for(src), name_for(src, chunk))

    outputs, unsent = [], []
    by_format: dict[str, list] = {}
    for f in cat.files:
        by_format.setdefault(file_format(f.path), []).append(f)
    groups = []
    for key, files in by_format.items():
        if len(files) > 1 and not fast:
            # each output keeps its own file's columns: one job per schema
            by_path = {f.path: f for f in files}
            groups += [(key, [by_path[p] for p in g])
                       for g in schema_groups(js, [f.path for f in files], _read_options(job, fast))]
        else:
            groups.append((key, files))
    per_file_sql: list = []
    whole_reads = job.rows == 0 and not writers.joinable(sink_fmt, job.compressed, job.output or cat.root)
    if whole_reads:
        read_files_whole(js, [f.length for f in cat.files])
    for key, files in groups:
        paths = [f.path for f in files]
        if sql_text:
            # Each file is its own input_data. Row-local SQL (projections and
            # filters) gives the same rows run once over all files, so it runs
            # as one job with every row tagged by its file; other SQL runs per
            # file. Row-locality is a property of the query's shape, so it is
            # decided on the first file: other SQL costs no read of all files.
            if not is_row_local(run_sql(_read(job_session(js), files[:1], job, fast),
                                        sql_text)):
                per_file_sql += files
                continue
            df = _read(js, files, job, fast, one_header=key in ("csv", "tsv"))
            inputs = df.inputFiles()
            queried = run_sql(df, sql_text)
            if not is_row_local(queried):
                per_file_sql += files
                continue
            df, _ = apply_steps(tag_rows(queried), job.steps, strict=job.strict)
            in_order = True
        else:
            df = _read(js, files, job, fast, tag=True, one_header=key in ("csv", "tsv"))
            # (records put together from splits read a table of splits besides the files)
            inputs = [fs.encoded(p) for p in paths] if key in ("csv", "tsv", "json") else df.inputFiles()
            df, in_order = stages(df, job, None, per_file=True)
        if job.rows > 0:
            df = chunking.add_chunks(df, job.rows, per_file=True, stable=in_order,
                                     keep_runs=True)
        outputs += layout.write_per_source(
            df, sink_fmt, stage_root, dest_for, [f.length for f in files],
            _splittable(key, paths, fast), job.compressed,
            chunked=job.rows > 0, xml_root=job.xml_root, inputs=inputs, protected=every)
        if job.url:
            unsent.append(record_lines(df, job.rows))
    if per_file_sql:
        written, records = _per_file_sql(js, job, per_file_sql, fast, sql_text, sink_fmt,
                                         out_dir_for, name_for, every)
        outputs += written
        unsent += records
    if cat.empty and job.rows == 0:
        bare = {dest_for(f.path, None): f.path for f in cat.empty}
        done = layout.write_bare(js, sink_fmt, list(bare), stage_root, job.compressed, job.xml_root, every)
        outputs += [layout.Written(bare[t], None, t) for t in done]
    result = JobResult("per_file", outputs, warnings=list(job.warnings))
    if unsent:
        result.delivery_log = _write_log(js, job, _deliver(unsent, job, transport, sleep))
    return result


ROW_LOCAL_NODES = ("Project", "Filter", "LogicalRelation", "Union", "Generate",
                   "SubqueryAlias", "View")


def is_row_local(df: DataFrame) -> bool:
    """Does every output row come from one input row, in a map-only plan?

    True when the optimized plan holds only projections, filters, explodes
    and unions over file scans — no aggregate, join, sort, limit or window.
    """
    stack = [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() not in ROW_LOCAL_NODES:
            return False
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return True


def tag_rows(df: DataFrame) -> DataFrame:
    """Source tags computed where the rows are read (map-only plans only)."""
    return df.select(
        "*",
        F.regexp_replace(F.input_file_name(), "^file:///", "file:/").alias(SRC_FILE),
        F.input_file_block_start().alias(SRC_BLOCK),
        F.monotonically_increasing_id().alias(SRC_POS))


# Files whose per-file SQL results share one Spark job (one union plan).
SQL_BATCH_FILES = 64


def _per_file_sql(js, job, files, fast, sql_text, sink_fmt, out_dir_for, name_for,
                  protected) -> tuple[list, list]:
    """SQL that is not row-local, each file its own ``input_data``: what was written,
    and the records to send.

    Unordered results: files are batched; in one session each file gets its
    own view, the per-file results are tagged with their file and unioned,
    and one job writes (and posts) the whole batch per file. Results with an
    ORDER BY keep one job per file, so the write keeps their order.
    """
    probe = run_sql(_read(job_session(js), files[:1], job, fast), sql_text)
    if len(files) > 1 and not layout.is_globally_sorted(probe):
        return _per_file_sql_batched(js, job, files, fast, sql_text, sink_fmt, out_dir_for,
                                     name_for, protected)

    def one(f):
        df = _read(job_session(js), [f], job, fast)
        df = run_sql(df, sql_text)
        df, _ = apply_steps(df, job.steps, strict=job.strict)
        d = out_dir_for(f.path)
        outs = []
        records = None
        if job.rows > 0:
            df = chunking.add_chunks(df, job.rows, stable=False)
            tagged = df.withColumn(SRC_FILE, F.lit(_encoded(js, f.path)))
            outs = layout.write_per_source(
                tagged, sink_fmt, d, lambda s, c: names.join(d, name_for(f.path, c)),
                [f.length], True,
                job.compressed, chunked=True, xml_root=job.xml_root,
                inputs=[_encoded(js, f.path)], protected=protected)
            if job.url:
                records = record_lines(tagged, job.rows)
        else:
            outs = [layout.write_single(df, sink_fmt, names.join(d, name_for(f.path, None)),
                                        job.compressed, job.xml_root, input_bytes=f.length)]
        return outs, records

    workers = max(1, min(job.parallel or 16, len(files)))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(one, files))
    outputs = [w for outs, _ in done for w in outs]
    return outputs, [records for _, records in done if records is not None]


def _per_file_sql_batched(js, job, files, fast, sql_text, sink_fmt, out_dir_for, name_for,
                          protected) -> tuple[list, list]:
    outputs, unsent = [], []

    def dest_for(src: str, chunk: int | None) -> str:
        return names.join(out_dir_for(src), name_for(src, chunk))

    for start in range(0, len(files), SQL_BATCH_FILES):
        batch = files[start:start + SQL_BATCH_FILES]
        bs = job_session(js)
        # reads (schema inference for CSV/JSON) run concurrently; views and
        # SQL analysis are cheap and done in order
        with ThreadPoolExecutor(max_workers=min(16, len(batch))) as pool:
            reads = list(pool.map(lambda f: _read(bs, [f], job, fast), batch))
        frames, encoded = [], []
        for i, (f, df_i) in enumerate(zip(batch, reads)):
            enc = _encoded(bs, f.path)
            encoded.append(enc)
            result = run_sql_as(df_i, sql_text, f"input_data_{i}")
            frames.append(result.withColumn(SRC_FILE, F.lit(enc)))
        # results with the same columns share a job: none gets another's columns
        alike: dict[str, list[int]] = {}
        for i, frame in enumerate(frames):
            alike.setdefault(frame.schema.json(), []).append(i)
        for own in alike.values():
            df = frames[own[0]]
            for i in own[1:]:
                df = df.unionByName(frames[i])
            df, _ = apply_steps(df, job.steps, strict=job.strict)
            if job.rows > 0:
                df = chunking.add_chunks(df, job.rows, per_file=True, stable=False,
                                         keep_runs=True)
            outputs += layout.write_per_source(
                df, sink_fmt, out_dir_for(batch[own[0]].path), dest_for,
                [batch[i].length for i in own], True, job.compressed, chunked=job.rows > 0,
                xml_root=job.xml_root, inputs=[encoded[i] for i in own], protected=protected)
            if job.url:
                unsent.append(record_lines(df, job.rows))
    return outputs, unsent


def _encoded(js, path: str) -> str:
    """The name Spark's file index gives ``path`` (what ``md5`` is taken of)."""
    jvm = js.sparkContext._jvm
    return HadoopFS(js).uri_form(str(jvm.org.apache.hadoop.fs.Path(path).toUri().toString()))


def _deliver(unsent: list[DataFrame], job: Job, transport, sleep) -> DataFrame:
    """Everything a job sends goes out in one stage, at one pace."""
    records = unsent[0]
    for more in unsent[1:]:
        records = records.unionByName(more)
    cfg = DeliveryConfig(url=job.url, rows=job.rows, headers=tuple(job.headers), max_rate=MAX_RATE)
    kwargs = {} if sleep is None else {"sleep": sleep}
    return send_paced(records, cfg, transport, max_concurrency=job.parallel, **kwargs)


def _write_log(js, job: Job, delivery_log: DataFrame) -> DataFrame:
    """Run the delivery exactly once: the attempt log is checkpointed (so
    reading it later never re-sends), then written if asked."""
    materialised = delivery_log.checkpoint(eager=True)
    if job.log:
        out_dir = job.output or "."
        layout.write_single(materialised.orderBy("source", "chunk", "attempt"), "ndjson",
                            names.join(out_dir, "response-logs.json"), input_bytes=0)
    return materialised


def explain_job(spark: SparkSession, job: Job, mode: str = "formatted") -> str:
    """The physical plan the job's main DataFrame would run (no credentials)."""
    job = job.validated()
    js = job_session(spark)
    cat = find_input_files(js, job.input)
    fast = _fast_lines(job, cat)
    df = _read(js, cat.files, job, fast)
    sql_text = read_sql_text(js, job.sql) if job.sql else (COUNT_SQL if job.count else None)
    df, _ = stages(df, job, sql_text, per_file=False)
    return df._jdf.queryExecution().explainString(
        js.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


__all__ = ["run", "explain_job", "JobResult", "stages", "SOURCE_COLS"]

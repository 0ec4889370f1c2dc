"""Format readers: one DataFrame over one or many files of one format.

Every read is a plain ``spark.read`` call with the right options; what is
ours is choosing them:

* CSV: header + type inference; integers widened to BIGINT; several files
  with different headers are read per header signature and combined by name
  (Spark alone would apply one file's header to all of them by position).
* TSV: the same with a tab; files of unequal headers combine by position,
  which needs equal widths (else the read fails).
* Parquet: files of unequal schema combine by name (``mergeSchema``).
* JSON: PERMISSIVE, so a malformed line stays as an all-NULL row and is
  counted; schema union by name over all rows; ISO timestamps inferred.
  One pass over all lines puts columns back in first-seen key order (Spark
  sorts inferred fields by name) and finds the columns whose every value is a
  plain date: those become DATE. A ``.json`` file whose first character is
  ``[`` is one array: its elements (``jsonarrays``) are read as lines are.
* XML: jobs name the *root* element; Spark wants the *row* tag. Every child
  element of a file's root is a row tag of that file. Files longer than a split
  are read in splits (``xmlrecords``).
* A ``schema`` (DDL text) skips inference for CSV, TSV and JSON; a CSV value
  that does not fit it fails the job.
* Raw lines (fast mode): ``read.text`` as one ``line`` column.

``tag=True`` adds three hidden columns that pin every row to its place in the
input: source file, split start and a position that increases within a
split. They are what row numbering, per-file output and ordered merges use;
unused, Catalyst prunes them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.functions.columns import col, widen_ints
from ferry.functions.internal import (CORRUPT, SOURCE_COLS, SRC_BLOCK, SRC_FILE, SRC_POS,
                                      refuse_reserved)
from ferry.functions.formats import compression_of, file_format, reader_kind, UnsupportedFormat
from ferry.session import ship_package
from ferry.sources import csvrecords, jsonarrays, probe, xmlrecords
from ferry.sinks.fs import HadoopFS
from ferry.sources.splits import one_task_per_file



@dataclass(frozen=True)
class ReadOptions:
    xml_root: str = "root"
    xml_row_tag: str | None = None
    fast: bool = False
    csv_multiline: bool = True
    schema: str | None = None  # DDL text; skips inference
    json_key_order: str = "first_seen"  # or "inferred"
    csv_one_header: bool = False  # the caller already grouped CSV files by header
    sizes: tuple[int, ...] = ()  # lengths of the files, where the caller knows them


GLOB_CHARS = "\\*?[]{}"


def literal(path: str) -> str:
    """Escape glob characters so Spark reads exactly this file (``data*x.csv``)."""
    return "".join("\\" + ch if ch in GLOB_CHARS else ch for ch in path)


def literals(paths: list[str]) -> list[str]:
    return [literal(p) for p in paths]


def read_files(spark: SparkSession, paths: list[str], options: ReadOptions | None = None,
               tag: bool = False, kind: str | None = None) -> DataFrame:
    """Read these files (exact names, never globs) as one DataFrame."""
    opts = options or ReadOptions()
    if not paths:
        raise ValueError("no input files")
    kinds = {reader_kind(p) for p in paths} if kind is None else {kind}
    if len(kinds) > 1:
        raise UnsupportedFormat(f"files of several formats in one read: {sorted(kinds)}")
    k = kinds.pop()
    if opts.fast:
        return _text(spark, paths, tag)
    if k == "parquet":
        _check_parquet(spark, paths)
        reader = spark.read.option("mergeSchema", "true") if len(paths) > 1 else spark.read
        return _tagged(reader.parquet(*literals(paths)), tag)
    if k == "csv":
        return _csv(spark, paths, ",", opts, tag, by_name=True)
    if k == "tsv":
        return _csv(spark, paths, "\t", opts, tag, by_name=False)
    if k == "json":
        return _json(spark, paths, opts, tag)
    if k == "xml":
        return _xml(spark, paths, opts, tag)
    raise UnsupportedFormat(f"Unsupported extension: {k}")


def _tagged(df: DataFrame, tag: bool) -> DataFrame:
    refuse_reserved(df.columns)
    if not tag:
        return df
    place = df.metadataColumn("_metadata")     # also where the data have a column of that name
    return df.select(
        "*",
        place["file_path"].alias(SRC_FILE),
        place["file_block_start"].alias(SRC_BLOCK),
        F.monotonically_increasing_id().alias(SRC_POS),
    )


def _text(spark: SparkSession, paths: list[str], tag: bool) -> DataFrame:
    df = spark.read.text(literals(paths)).withColumnRenamed("value", "line")
    return _tagged(df, tag)


def _check_parquet(spark: SparkSession, paths: list[str]) -> None:
    """A ``.parquet.gz`` must be Parquet inside (inner codec), not gzip outside."""
    fs = HadoopFS(spark)
    for p in paths:
        if compression_of(p):
            path = fs._path(p)
            stream = path.getFileSystem(fs._conf).open(path)
            try:
                magic = bytes(stream.readNBytes(4))
            finally:
                stream.close()
            if magic != b"PAR1":
                raise UnsupportedFormat(
                    f"{p}: not a Parquet file (a whole-file gzip around Parquet is not readable)")


def _csv(spark: SparkSession, paths: list[str], sep: str, opts: ReadOptions, tag: bool,
         by_name: bool) -> DataFrame:
    def read(group: list[str], header: str | None = None) -> DataFrame:
        if _in_records(spark, group, opts):
            header = probe.header_records(spark, group[:1])[group[0]] if header is None else header
            df = csvrecords.read(spark, literals(group), header, sep, opts.schema)
            refuse_reserved([c for c in df.columns if c not in SOURCE_COLS])
            return df if tag else df.drop(*SOURCE_COLS)
        reader = (spark.read
                  .option("header", "true")
                  .option("inferSchema", "true")
                  .option("sep", sep)
                  .option("escape", '"')
                  .option("multiLine", "true" if opts.csv_multiline else "false")
                  .option("mode", "PERMISSIVE"))
        if opts.schema:
            reader = reader.schema(opts.schema).option("inferSchema", "false") \
                           .option("mode", "FAILFAST").option("enforceSchema", "false")
            return _tagged(reader.csv(literals(group)), tag)
        schema = widen_ints(reader.csv(literals(group))).schema
        if not schema.fields:
            return _tagged(reader.csv(literals(group)), tag)
        refuse_reserved(schema.names)
        shape = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        df = reader.schema(shape).option("inferSchema", "false").option("columnNameOfCorruptRecord", CORRUPT) \
            .csv(literals(group))
        return _tagged(csvrecords.without_extra_cells(df, len(schema), sep), tag)

    if len(paths) == 1 or opts.csv_one_header:
        return read(paths)
    frames = [read(g) for g in header_groups(spark, paths)]
    out = frames[0]
    for f in frames[1:]:
        if by_name:
            out = out.unionByName(f, allowMissingColumns=True)
        elif len(f.columns) != len(out.columns):
            raise UnsupportedFormat("files combined by position need equally many columns: "
                                    f"{len(out.columns)} and {len(f.columns)}")
        else:
            out = out.union(f)
    return out


def _in_records(spark: SparkSession, group: list[str], opts: ReadOptions) -> bool:
    """Are these files read as records put together from splits?

    Where a file is longer than a split (the plain multi-line reader gives it to one
    task), and where a name holds glob characters (its inference lists files anew,
    with the escapes dropped). The rows are the same either way.
    """
    if not opts.csv_multiline or any(compression_of(p) for p in group):
        return False
    if any(ch in p for p in group for ch in GLOB_CHARS):
        return True
    return _longer_than_split(spark, group, opts)


def _longer_than_split(spark: SparkSession, group: list[str], opts: ReadOptions) -> bool:
    """Is one of these files, uncompressed, longer than a split?"""
    if any(compression_of(p) for p in group):
        return False
    sizes = list(opts.sizes)
    if not sizes:
        files = spark.read.format("binaryFile").load(literals(group)).agg(F.max("length"), F.sum("length")).first()
        sizes = [files[0] or 0, (files[1] or 0) - (files[0] or 0)]
    return not one_task_per_file(spark, sizes, True)


def header_groups(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """CSV/TSV files grouped by their header record (first-seen order of headers)."""
    if len(paths) == 1:
        return [paths]
    return _grouped(probe.header_records(spark, paths), paths)


def _grouped(signature: dict, paths: list[str]) -> list[list[str]]:
    groups: dict = {}
    for p in paths:
        groups.setdefault(signature.get(p), []).append(p)
    return list(groups.values())


def schema_groups(spark: SparkSession, paths: list[str], options: ReadOptions) -> list[list[str]]:
    """Files of one format grouped so that files with the same columns are read
    together and no file gets columns of another."""
    if len(paths) == 1 or options.schema:
        return [paths]
    k = reader_kind(paths[0])
    if k in ("csv", "tsv"):
        sep = "," if k == "csv" else "\t"
        return [own for g in header_groups(spark, paths) for own in _type_groups(spark, g, sep, options)]
    if k == "parquet":
        _check_parquet(spark, paths)
        many = probe.in_tasks(spark, paths, probe.parquet_columns) if len(paths) > probe.DRIVER_FILES else None
        if many is not None:
            return _grouped(many, paths)
        with ThreadPoolExecutor(max_workers=min(16, len(paths))) as pool:
            shown = pool.map(lambda p: spark.read.parquet(literal(p)).schema.json(), paths)
        return _grouped(dict(zip(paths, shown)), paths)
    if k == "xml":
        shapes = xml_shapes(spark, paths, options)
        return _grouped({p: str(sorted((t, sorted(f)) for t, f in shape.items()))
                         for p, shape in shapes.items()}, paths)
    arrays = probe.first_chars(spark, [p for p in paths if file_format(p) == "json"] or paths[:1])
    lines = [p for p in paths if arrays.get(p) != "["]
    groups = [[p] for p in paths if arrays.get(p) == "["]
    return (_grouped(_json_keys(spark, lines), lines) if lines else []) + groups


def _type_groups(spark: SparkSession, paths: list[str], sep: str, opts: ReadOptions) -> list[list[str]]:
    """CSV/TSV files of one header grouped by the kinds of their columns, so that no
    file's types depend on its neighbours: one job, one short row per file.

    The kinds only decide which files are read together; Spark infers the types.
    """
    if len(paths) == 1 or not opts.csv_multiline:
        return [paths]
    fs = HadoopFS(spark)
    df = spark.read.options(header="true", sep=sep, escape='"', multiLine="true", inferSchema="false")
    names = df.csv(literal(paths[0])).columns      # the header; no pass over the rows
    if not names:
        return [paths]
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if _in_records(spark, paths, opts):
        own = F.from_csv(csvrecords.VALUE, shape.simpleString()[7:-1].replace(":", " "), {"sep": sep, "escape": '"'})
        df = csvrecords.records(spark, literals(paths)).select(own.alias("r"), F.col(SRC_FILE).alias("f")).select("r.*", "f")
    else:
        df = df.schema(shape).csv(literals(paths)).select("*", F.col("_metadata.file_path").alias("f"))
    kinds = []
    for i in range(len(names)):
        v = F.col(f"c{i}")
        tests = [("int", v.rlike(r"^[+-]?[0-9]+$")), ("real", v.cast("string").rlike(NUMBER_RE)),
                 ("bool", F.lower(v).isin("true", "false")), ("date", v.rlike(DATE_RE)), ("time", v.rlike(TIME_RE))]
        seen = F.count(v)
        kind = F.lit("text")
        for name, test in reversed(tests):
            kind = F.when(F.count_if(test) == seen, name).otherwise(kind)
        kinds.append(F.when(seen == 0, "none").otherwise(kind))
    rows = df.groupBy("f").agg(F.concat_ws(",", *kinds).alias("kinds")).collect()
    found = {r.f: r.kinds for r in rows}
    return _grouped({p: found.get(fs.encoded(p)) for p in paths}, paths)


NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?$"
TIME_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"


def _json_keys(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The set of top-level keys of each file: one job, one short row per file."""
    fs = HadoopFS(spark)
    rows = (spark.read.text(literals(paths))
            .select(F.col("_metadata.file_path").alias("f"),
                    F.explode(F.json_object_keys("value")).alias("key"))
            .groupBy("f").agg(F.array_join(F.array_sort(F.collect_set("key")), "\n").alias("keys")).collect())
    found = {fs.uri_to_path(r.f): r["keys"] for r in rows}
    by_name = {str(fs._path(p).toUri().getPath()): k for p, k in found.items()}
    return {p: by_name.get(str(fs._path(p).toUri().getPath())) for p in paths}


def _json_elements(spark: SparkSession, group: list[str], opts: ReadOptions, tag: bool) -> DataFrame | None:
    """Array files read in splits, with the types and key order of JSON lines; None if
    no element has a key."""
    rows = jsonarrays.elements(spark, literals(group))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    order, dates = None, []
    if opts.schema:
        schema = T._parse_datatype_string(opts.schema)
    else:
        strings = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
        reader = spark.read.options(inferTimestamp="true", **options)._jreader
        texts = rows.select(csvrecords.VALUE)
        schema = DataFrame(reader.json(getattr(texts._jdf, "as")(strings)), spark).schema
        schema = T.StructType([f for f in schema.fields if f.name != CORRUPT])
        if not schema.fields:
            return None
        if opts.json_key_order == "first_seen":
            order, dates = _key_facts(rows.select(
                F.col(csvrecords.VALUE).alias("value"), F.col(SRC_FILE).alias("f"), F.col(SRC_BLOCK).alias("b"),
                F.col(SRC_POS).alias("m")), _timestamps(schema))
    refuse_reserved(schema.names)
    own = [F.col("r").getField(n) for n in schema.names]
    out = rows.select(F.from_json(csvrecords.VALUE, schema, options).alias("r"), *SOURCE_COLS) \
        .select(*(c.alias(n) for c, n in zip(own, schema.names)), *SOURCE_COLS)
    if order is not None:
        out = out.select(*_ordered(schema.names, order, dates), *SOURCE_COLS)
    return out if tag else out.drop(*SOURCE_COLS)


def _timestamps(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def _ordered(names: list[str], order: list[str], dates: list[str]) -> list[Column]:
    known = [c for c in order if c in names]
    return [F.to_date(col(c)).alias(c) if c in dates else col(c) for c in known + [c for c in names if c not in known]]


def _json(spark: SparkSession, paths: list[str], opts: ReadOptions, tag: bool) -> DataFrame:
    array_files, line_files = [], []
    maybe_array = [p for p in paths if file_format(p) == "json"]
    firsts = probe.first_chars(spark, maybe_array) if maybe_array else {}
    for p in paths:
        (array_files if firsts.get(p) == "[" else line_files).append(p)

    def read(group: list[str], multiline: bool) -> DataFrame:
        reader = (spark.read
                  .option("mode", "PERMISSIVE")
                  .option("inferTimestamp", "true")
                  .option("columnNameOfCorruptRecord", CORRUPT)
                  .option("multiLine", "true" if multiline else "false"))
        if opts.schema:
            return _tagged(reader.schema(opts.schema).json(literals(group)), tag)
        df = reader.json(literals(group))
        if CORRUPT in df.columns:
            df = df.drop(CORRUPT)
        if not multiline and opts.json_key_order == "first_seen" and df.columns:
            order, dates = json_facts(spark, group, _timestamps(df.schema))
            df = df.select(_ordered(df.columns, order, dates))
        return _tagged(df, tag)

    frames = []
    if line_files:
        frames.append(read(line_files, False))
    if array_files:
        found = _json_elements(spark, array_files, opts, tag)
        frames.append(read(array_files, True) if found is None else found)     # None: empty arrays
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _json_field(name: str) -> Column:
    """A top-level field of the JSON text in ``value``, as text."""
    if "'" not in name:
        return F.get_json_object("value", f"$['{name}']")
    # a path cannot hold the quote; a schema can hold any name
    shape = T.StructType([T.StructField(name, T.StringType())])
    return F.from_json("value", shape).getField(name)


DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def json_facts(spark: SparkSession, paths: list[str], ts_cols: list[str]) -> tuple[list[str], list[str]]:
    """Key order (first seen) and date-only columns, from all lines.

    Keys are ordered by their earliest (file, split, line, position). A
    timestamp column counts as DATE when every value is ``yyyy-mm-dd``. One
    job with map-side aggregation; one row per key reaches the driver.
    """
    lines = (spark.read.text(literals(paths))
             .select(F.col("value"),
                     F.col("_metadata.file_path").alias("f"),
                     F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("m"))
             .where(F.ltrim(F.col("value")).startswith("{")))
    return _key_facts(lines, ts_cols)


def _key_facts(lines: DataFrame, ts_cols: list[str]) -> tuple[list[str], list[str]]:
    """``json_facts`` of JSON objects in ``value`` with their places f, b and m."""
    # Lines are first grouped by their list of keys (few lists, whatever the
    # number of lines); only these lists are taken apart. Per timestamp column:
    # how many values are present and how many of those are not yyyy-mm-dd.
    found = []
    for i, c in enumerate(ts_cols):
        v = _json_field(c)
        found += [F.count(v).alias(f"n{i}"), F.count(F.when(~v.rlike(DATE_RE), v)).alias(f"x{i}")]
    # First within splits, where numbers alone are kept (no sort of the lines).
    lists = lines.groupBy(F.json_object_keys("value").alias("keys"), "f", "b").agg(F.min("m").alias("m"), *found) \
        .groupBy("keys").agg(F.min(F.struct("f", "b", "m")).alias("o"),
                             *(F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(ts_cols)) for k in "nx"))

    def of(prefix: str) -> Column:
        own = F.lit(0).cast("long")
        for i, c in enumerate(ts_cols):
            own = F.when(F.col("key") == c, F.col(f"{prefix}{i}")).otherwise(own)
        return F.sum(own)

    facts = (lists.select("*", F.posexplode(F.array_distinct("keys")).alias("p", "key"))
             .groupBy("key").agg(F.min(F.struct("o", "p")).alias("at"), of("n").alias("n"), of("x").alias("bad"))
             .orderBy("at").select("key", "n", "bad").collect())
    order = [r.key for r in facts]
    wanted = set(ts_cols)
    dates = [r.key for r in facts if r.key in wanted and (r.n or 0) > 0 and not r.bad]
    return order, dates


#: largest XML file looked through by a task that gets it from Spark as one value
XML_SCAN_BYTES = 1 << 30


def _xml_scans(spark: SparkSession, paths: list[str], root: str) -> dict[str, dict]:
    """Per file what ``probe.xml_children`` says: every file is looked through by one
    task, piece by piece; only element names come back."""
    import json

    def answer(src, path: str) -> str:
        try:
            return json.dumps(probe.xml_children(probe._decompressed(src, path), root))
        except ValueError as e:
            return json.dumps({"error": str(e)})
        except SyntaxError as e:
            return json.dumps({"error": f"not well-formed: {e}"})

    found = probe.in_tasks(spark, paths, answer)
    if found is None:
        # a storage that only Spark opens
        ship_package(spark)
        fs = HadoopFS(spark)
        files = spark.read.format("binaryFile").load(literals(paths))
        big = files.where(F.col("length") > XML_SCAN_BYTES).select("path").limit(1).collect()
        if big:
            raise UnsupportedFormat(f"{big[0].path}: too large to look for its row element; give xml_row_tag")

        def scan(batches):
            import io
            import pandas as pd
            for pdf in batches:
                yield pd.DataFrame([(p, answer(io.BytesIO(c), p)) for p, c in zip(pdf["path"], pdf["content"])],
                                   columns=["path", "answer"])

        plain = lambda p: str(fs._path(p).toUri().getPath())
        rows = files.select("path", "content").mapInPandas(scan, "path string, answer string").collect()
        by_name = {plain(r.path): r.answer for r in rows}
        found = {p: by_name[plain(p)] for p in paths}
    found = {p: json.loads(a) for p, a in found.items()}
    for path, scan in found.items():
        if "error" in scan:
            raise UnsupportedFormat(f"{path}: {scan['error']}")
    return found


def xml_shapes(spark: SparkSession, paths: list[str], opts: ReadOptions) -> dict[str, dict[str, list[str]]]:
    """Per file, the row tags under the root and the fields of each."""
    return {p: scan["tags"] for p, scan in _xml_scans(spark, paths, opts.xml_root).items()}


def _xml(spark: SparkSession, paths: list[str], opts: ReadOptions, tag: bool) -> DataFrame:
    plain: set[str] = set()
    if opts.xml_row_tag:
        by_tag = {opts.xml_row_tag: list(paths)}
    else:
        by_tag: dict[str, list[str]] = {}
        for p, scan in _xml_scans(spark, paths, opts.xml_root).items():
            if scan["plain"]:
                plain.add(p)
            for t in scan["tags"]:
                by_tag.setdefault(t, []).append(p)
        if not by_tag:
            raise UnsupportedFormat(f"{paths[0]}: no row element found under <{opts.xml_root}>")
    out = None
    for row_tag, files in by_tag.items():
        options = {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                   "ignoreSurroundingSpaces": "true"}
        if plain.issuperset(files) and _longer_than_split(spark, files, opts):
            df = xmlrecords.read(spark, literals(files), row_tag, options)
            refuse_reserved([c for c in df.columns if c not in SOURCE_COLS])
            df = df if tag else df.drop(*SOURCE_COLS)
        else:
            df = spark.read.format("xml").options(**options).load(literals(files))
            if CORRUPT in df.columns:
                df = df.drop(CORRUPT)
            df = _tagged(widen_ints(df), tag)
        if df.columns or out is None:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

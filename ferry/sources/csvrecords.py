"""CSV and TSV files read in splits, with newlines inside quotes.

A line break ends a record unless an odd number of quotes comes before it in the
file. So it is enough to know, for every split, whether the quotes before it are
odd: each split's quotes are counted (one pass, in the JVM), and a running sum
over the splits of a file gives where each one starts. The lines are then put
together to records in scan order, split by split. A record that reaches over a
split boundary is put together from its pieces, at most two per split, and takes
its place between the two splits.

Records are parsed by Spark's own CSV parser, and types are inferred by its own
inference over all records. Only files that one task would not read whole take
this path; the plain reader gives the same rows for the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.functions.columns import col
from ferry.functions.internal import CORRUPT, PREFIX, SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.session import scratch_path, ship_package

VALUE, QUOTES, INSIDE, KIND = PREFIX + "value", PREFIX + "quotes", PREFIX + "inside", PREFIX + "kind"
# whole records; the head of a split that starts inside a record, the open record at
# its end; the same two for a file's first record, its header
RECORD, HEAD, TAIL, HEADER, OPEN_HEADER = range(5)
# splits that start inside quotes are broadcast up to this many, else joined by a shuffle
MAX_BROADCAST_SPLITS = 200_000
OUT = f"{VALUE} string, {SRC_FILE} string, {SRC_BLOCK} long, {KIND} int, {SRC_POS} long"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.option("lineSep", "\n").text(paths)
    place = df.metadataColumn("_metadata")
    return df.select(F.col("value").alias(VALUE), place["file_path"].alias(SRC_FILE),
                     place["file_block_start"].alias(SRC_BLOCK),
                     ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
                     .cast("int").alias(QUOTES))


def split_starts(lines: DataFrame) -> DataFrame:
    """file, block of the splits that start inside quotes."""
    odd = lines.groupBy(SRC_FILE, SRC_BLOCK).agg((F.sum(QUOTES) % 2).alias("odd"))
    before = Window.partitionBy(SRC_FILE).orderBy(SRC_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("before", F.sum("odd").over(before) % 2).filter("before = 1").select(SRC_FILE, SRC_BLOCK)


class _Split:
    """The lines of one split in order, put together to records."""

    def __init__(self, file: str, block: int, inside: bool):
        self.key, self.inside, self.open, self.given = (file, block), inside, [], 0
        self.kind = HEAD if inside else HEADER if block == 0 else RECORD      # of the next record

    def add(self, values, quotes: np.ndarray):
        """(records, kinds) completed by these lines."""
        parity = (np.cumsum(quotes) + self.inside) % 2       # after each line
        ends = np.flatnonzero(parity == 0)
        self.inside = bool(parity[-1])
        if not self.open and self.kind == RECORD and len(ends) == len(parity):
            return values, np.zeros(len(values), np.int32)    # every line is a record
        done, at = [], 0
        texts = values.to_pylist()
        for end in ends:
            done.append("\n".join([*self.open, *texts[at:end + 1]]))
            self.open, at = [], int(end) + 1
        self.open += texts[at:]
        kinds = np.zeros(len(done), np.int32)
        for i, text in enumerate(done):
            if self.kind == RECORD:
                break
            kinds[i] = self.kind
            if self.kind == HEAD or text.strip("\ufeff\r"):      # blank lines before the header
                self.kind = RECORD
        return done, kinds

    def rest(self) -> list[tuple[str, int]]:
        """What is open at the split's end."""
        kind = {RECORD: TAIL, HEAD: HEAD, HEADER: OPEN_HEADER}[self.kind]
        return [("\n".join(self.open), kind)] if self.open else []


def split_records(lines: DataFrame, kinds: tuple[int, ...], per_line: str, start: list[str], make) -> DataFrame:
    """The records, or pieces of records, of these kinds.

    ``make(file, block, *start values)`` gives a split's state; its ``add(values,
    column per_line)`` the records that lines complete, with their kinds, and its
    ``rest()`` what is open at the end.
    """
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        split, wanted = None, np.array(kinds)

        def rows(texts, found, split):
            texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
            keep = pc.and_(pa.array(np.isin(found, wanted)), pc.invert(pc.is_in(texts, pa.array(["", "\r"]))))
            texts, found = texts.filter(keep), pa.array(found, pa.int32()).filter(keep)
            n = len(texts)
            split.given += n
            return pa.RecordBatch.from_arrays(
                [texts, pa.array([split.key[0]] * n, pa.string()), pa.array([split.key[1]] * n, pa.int64()), found,
                 pa.array(range(split.given - n, split.given), pa.int64())],
                [VALUE, SRC_FILE, SRC_BLOCK, KIND, SRC_POS])

        def close():
            for text, kind in split.rest() if split else ():
                yield rows([text], [kind], split)

        for batch in batches:
            if not batch.num_rows:
                continue
            values, files, blocks, per, *starts = batch.columns
            blocks, per = blocks.to_numpy(), per.to_numpy(zero_copy_only=False)
            files = files.dictionary_encode()
            code = files.indices.to_numpy()
            cuts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(blocks) != 0)))
            for start, end in zip(cuts, [*cuts[1:], len(blocks)]):
                key = (files.dictionary[int(code[start])].as_py(), int(blocks[start]))
                if split is None or split.key != key:
                    yield from close()
                    split = make(*key, *(c[int(start)].as_py() for c in starts))
                texts, found = split.add(values.slice(start, end - start), per[start:end])
                if len(texts):
                    yield rows(texts, found, split)
        yield from close()

    return lines.select(VALUE, SRC_FILE, SRC_BLOCK, per_line, *start).mapInArrow(run, OUT)


def with_starts(lines: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """``lines`` with the columns of the few rows ``starts`` (file, block, ...), in scan
    order: broadcast up to MAX_BROADCAST_SPLITS rows, else joined by a shuffle."""
    if n <= MAX_BROADCAST_SPLITS:
        return lines.join(F.broadcast(starts), [SRC_FILE, SRC_BLOCK], "left")
    return lines.withColumn(SRC_POS, F.monotonically_increasing_id()) \
        .join(starts.hint("shuffle_hash"), [SRC_FILE, SRC_BLOCK], "left") \
        .repartition(SRC_FILE, SRC_BLOCK).sortWithinPartitions(SRC_FILE, SRC_BLOCK, SRC_POS)


def crossing_records(pieces: DataFrame, between: str) -> DataFrame:
    """The records put together from pieces (an open one and the heads behind it, in
    file order), ``between`` being what was cut away between lines."""
    upto = Window.partitionBy(SRC_FILE).orderBy(SRC_BLOCK, KIND).rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("of", F.sum((F.col(KIND) != HEAD).cast("long")).over(upto))
    parts = F.array_sort(F.collect_list(F.struct(SRC_BLOCK, KIND, VALUE)))
    return pieces.groupBy(SRC_FILE, "of").agg(
        F.array_join(F.transform(parts, lambda p: p[VALUE]), between).alias(VALUE),
        F.max(KIND).alias(KIND),
        # a place between the split it starts in and the next one
        F.coalesce(F.min(F.when(F.col(KIND) == HEAD, F.col(SRC_BLOCK))) - 1, F.max(SRC_BLOCK) + 1).alias(SRC_BLOCK)) \
        .filter(F.col(KIND) != OPEN_HEADER).select(VALUE, SRC_FILE, SRC_BLOCK, F.lit(0).cast("long").alias(SRC_POS))


def staged_starts(spark: SparkSession, starts: DataFrame) -> tuple[DataFrame, int]:
    """The table of split starts (a row per split at most), written once."""
    path = scratch_path(spark, "split-starts")
    starts.write.parquet(path)
    starts = spark.read.schema(starts.schema).parquet(path)
    return starts, starts.count()


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every record but the files' headers and blank lines: value, file, block and pos
    (increasing by one within a split). ``paths``: escaped file names."""
    ship_package(spark)
    lines = _lines(spark, paths)
    starts, n = staged_starts(spark, split_starts(lines).withColumn(INSIDE, F.lit(True)))
    marked = with_starts(lines, starts, n) if n else lines.withColumn(INSIDE, F.lit(False))
    marked = marked.withColumn(INSIDE, F.coalesce(INSIDE, F.lit(False)))
    found = split_records(marked, (RECORD,), QUOTES, [INSIDE], _Split).drop(KIND)
    if n:
        pieces = split_records(marked, (HEAD, TAIL, OPEN_HEADER), QUOTES, [INSIDE], _Split)
        found = found.unionByName(crossing_records(pieces, "\n"))
    return found.withColumn(VALUE, F.regexp_replace(VALUE, "\r$", ""))


def cells(record: Column, sep: str) -> Column:
    """The number of cells of a record: separators outside quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def without_extra_cells(df: DataFrame, n: int, sep: str) -> DataFrame:
    """``df`` without its column ``CORRUPT``; a row with more than ``n`` cells fails the job."""
    first = F.coalesce(col(df.columns[0]).cast("string"), F.lit(""))
    said = F.concat(F.lit(f"a row has more cells than its header ({n}); it starts with: "), first, F.lit(" - "),
                    F.substring(CORRUPT, 1, 200))
    ok = F.when(F.col(CORRUPT).isNotNull() & (cells(F.col(CORRUPT), sep) > n), F.raise_error(said)).otherwise(F.lit(True))
    return df.filter(ok.cast("boolean")).drop(CORRUPT)


def read(spark: SparkSession, paths: list[str], header: str, sep: str, schema: str | None = None) -> DataFrame:
    """The files' columns and, for every row, its file, block and pos.

    All files share the header record ``header``; ``schema`` (DDL) skips the inference,
    and values that do not fit it fail the job. ``paths``: escaped file names.
    """
    strings = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()

    def parsed(df: DataFrame, **options) -> DataFrame:
        reader = spark.read.options(sep=sep, escape='"', **options)
        return DataFrame(reader._jreader.csv(getattr(df._jdf, "as")(strings)), spark)

    names = parsed(spark.createDataFrame([(header,)], "value string"), header="true").columns
    rows = records(spark, paths)
    if schema:
        fields = T._parse_datatype_string(schema).fields
        if [f.name.lower() for f in fields] != [n.lower() for n in names]:
            raise ValueError(f"the given schema's columns are not those of the header: {names}")
        kinds = [f.dataType for f in fields]
        names = [f.name for f in fields]
    else:
        # a first record of empty cells sets the number of columns and no type
        width = spark.createDataFrame([(sep.join(['""'] * len(names)),)], f"{VALUE} string").coalesce(1)
        inferred = parsed(width.unionByName(rows.select(VALUE)), header="false", inferSchema="true").schema.fields
        kinds = [T.LongType() if f.dataType == T.IntegerType() else f.dataType for f in inferred[:len(names)]]
    shape = ", ".join(f"c{i} {t.simpleString()}" for i, t in enumerate(kinds))
    options = {"sep": sep, "escape": '"', "mode": "FAILFAST" if schema else "PERMISSIVE"}
    if not schema:
        shape += f", {CORRUPT} string"
        options["columnNameOfCorruptRecord"] = CORRUPT
    tags = [SRC_FILE, SRC_BLOCK, SRC_POS]
    out = rows.select(F.from_csv(VALUE, shape, options).alias("r"), *tags)
    own = [F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]
    out = out.select(*own, *([] if schema else [F.col(f"r.{CORRUPT}").alias(CORRUPT)]), *tags)
    return out if schema else without_extra_cells(out, len(names), sep)

"""XML files read in splits: a row element is what ends at its end tag.

Spark's XML reader gives a file to one task, for the types and for the rows. Where a
row's end tag stands only at rows' ends (``probe.xml_children`` says so), the file is
read as text cut at that tag, in splits; types come from Spark's own inference over
the rows, and each is parsed by Spark's own parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.functions.columns import widen_ints
from ferry.functions.internal import CORRUPT, PREFIX, SRC_BLOCK, SRC_FILE, SRC_POS

VALUE = PREFIX + "value"


def rows(spark: SparkSession, paths: list[str], row_tag: str) -> DataFrame:
    """Every row element with its place: value, file, block and pos."""
    end = f"</{row_tag}>"
    df = spark.read.option("lineSep", end).text(paths)
    place = df.metadataColumn("_metadata")
    # what stands before a row's start: the root's start tag or blanks
    start = F.regexp_instr("value", F.lit(f"<{row_tag.replace('.', '[.]')}[\\s>]"))
    return df.select("value", start.alias("start"), place["file_path"].alias(SRC_FILE),
                     place["file_block_start"].alias(SRC_BLOCK), F.monotonically_increasing_id().alias(SRC_POS)) \
        .filter("start > 0").select(F.concat(F.substr("value", F.col("start")), F.lit(end)).alias(VALUE),
                                    SRC_FILE, SRC_BLOCK, SRC_POS)


def read(spark: SparkSession, paths: list[str], row_tag: str, options: dict) -> DataFrame:
    """The files' columns and, for every row, its file, block and pos. ``paths``:
    escaped file names."""
    found = rows(spark, paths, row_tag)
    strings = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    texts = found.select(VALUE)
    reader = spark.read.options(**options)._jreader
    inferred = widen_ints(DataFrame(reader.xml(getattr(texts._jdf, "as")(strings)), spark)).schema
    fields = [f for f in inferred.fields if f.name != CORRUPT]
    # the parser's record of what it could not read is not kept
    shape = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    parsed = found.select(F.from_xml(VALUE, shape, options).alias("r"), SRC_FILE, SRC_BLOCK, SRC_POS)
    return parsed.select(*(F.col("r").getField(f.name).alias(f.name) for f in fields), SRC_FILE, SRC_BLOCK, SRC_POS)

"""Writer options per output format.

* CSV/TSV: header; quotes doubled (``escape='"'``); leading/trailing blanks
  kept (Spark trims them by default); nested values as JSON text;
  timestamps as ``CAST(ts AS STRING)`` text.
* NDJSON/JSON: one object per line, ``null`` fields kept, timestamps as text.
* Parquet: as is; ``compressed`` selects the gzip codec inside the file.
* XML: real XML under a root tag (``rowTag`` elements).
* Raw lines: the ``line`` (or ``value``) column byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter

from ferry.functions.columns import nested_to_text, temporal_to_text
from ferry.operators.rowindex import RUN_COLS
from ferry.sources.cloud import ASSEMBLED_SCHEMES, scheme_of
from ferry.functions.internal import SOURCE_COLS

TEXT_FORMATS = ("csv", "tsv", "ndjson", "jsonl", "json", "xml", "lines")


def prepare(df: DataFrame, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shape columns for a sink; hidden source columns are dropped unless kept."""
    drop = [c for c in SOURCE_COLS + RUN_COLS if c in df.columns and c not in keep]
    if drop:
        df = df.drop(*drop)
    if fmt in ("csv", "tsv"):
        return nested_to_text(temporal_to_text(df))
    if fmt in ("ndjson", "jsonl", "json", "xml"):
        return temporal_to_text(df)
    return df


# Formats whose files may be joined byte for byte (parts of one output).
CONCAT_FORMATS = ("csv", "tsv", "ndjson", "jsonl", "json", "lines")


def joinable(fmt: str, compressed: bool, where: str = "") -> bool:
    """Can one output be assembled from parts? Text formats always; XML when
    not compressed (each part's declaration and root element are stripped);
    Parquet on every storage that executors can open files of (``where``)."""
    if fmt == "parquet":
        return scheme_of(where) in ASSEMBLED_SCHEMES
    return fmt in CONCAT_FORMATS or (fmt == "xml" and not compressed)


def writer(df: DataFrame, fmt: str, compressed: bool = False,
           xml_root: str = "root", xml_row: str = "row", header: bool = True) -> DataFrameWriter:
    # one file per task and output: the layouts rely on it
    w = df.write.mode("overwrite").option("maxRecordsPerFile", 0)
    codec = "gzip" if compressed else None
    if fmt == "parquet":
        return w.format("parquet").option("compression", codec or "snappy")
    if fmt in ("csv", "tsv"):
        w = (w.format("csv").option("header", "true" if header else "false")
             .option("escape", '"')
             # Spark's CSV writer trims values unless told not to; keep them whole
             .option("ignoreLeadingWhiteSpace", "false")
             .option("ignoreTrailingWhiteSpace", "false")
             .option("sep", "\t" if fmt == "tsv" else ","))
    elif fmt in ("ndjson", "jsonl", "json"):
        w = w.format("json").option("ignoreNullFields", "false")
    elif fmt == "xml":
        w = w.format("xml").option("rootTag", xml_root).option("rowTag", xml_row)
    elif fmt == "lines":
        w = w.format("text")
    else:
        raise ValueError(f"unknown output format {fmt}")
    if codec:
        w = w.option("compression", codec)
    return w

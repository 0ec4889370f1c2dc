"""Format and compression rules keyed by file-name suffix (case-insensitive)."""

from __future__ import annotations

import posixpath
import re

# Fixed values that must equal the reference's behaviour:
# readable data extensions, compression suffixes, output format names and the
# extension each output format writes.
INPUT_EXTENSIONS = ("parquet", "csv", "tsv", "ndjson", "jsonl", "json", "xml")
COMPRESSION_EXTENSIONS = ("gz", "bz2", "xz", "zst")
OUTPUT_FORMATS = ("ndjson", "parquet", "csv", "tsv", "xml", "jsonl", "json")
OUTPUT_EXTENSION = {
    "ndjson": "ndjson",
    "parquet": "parquet",
    "csv": "csv",
    "tsv": "tsv",
    "xml": "xml",
    "jsonl": "json",
    "json": "json",
}
JSON_FORMATS = ("ndjson", "jsonl", "json")

# Extension → reader kind used by ferry.sources.readers.
READER_KIND = {
    "parquet": "parquet",
    "csv": "csv",
    "tsv": "tsv",
    "ndjson": "json",
    "jsonl": "json",
    "json": "json",
    "xml": "xml",
}

# Spark reads gz, bz2 and zst through Hadoop codecs; xz has no codec there.
UNREADABLE_COMPRESSION = ("xz",)

DATA_FILE_RE = re.compile(
    r"\.(" + "|".join(INPUT_EXTENSIONS) + r")(\.(" + "|".join(COMPRESSION_EXTENSIONS) + r"))?$",
    re.IGNORECASE,
)


class UnsupportedFormat(ValueError):
    pass


def basename(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def compression_of(path: str) -> str | None:
    name = basename(path).lower()
    for c in COMPRESSION_EXTENSIONS:
        if name.endswith("." + c):
            return c
    return None


def file_format(path: str) -> str:
    """Data extension of a file name: ``a.csv.gz`` → ``csv``; lower-cased."""
    name = basename(path)
    comp = compression_of(name)
    if comp:
        name = name[: -(len(comp) + 1)]
    if "." not in name:
        return ""
    return name.rsplit(".", 1)[1].lower()


def reader_kind(path: str) -> str:
    ext = file_format(path)
    if ext not in READER_KIND:
        raise UnsupportedFormat(f"Unsupported extension: {ext}")
    comp = compression_of(path)
    if comp in UNREADABLE_COMPRESSION:
        raise UnsupportedFormat(
            f"Compressed input '.{comp}' is not readable by Spark's codecs: {path}")
    return READER_KIND[ext]


def is_data_file(path: str) -> bool:
    return bool(DATA_FILE_RE.search(basename(path)))


def output_extension(fmt: str) -> str:
    if fmt not in OUTPUT_EXTENSION:
        raise UnsupportedFormat(f"no writer for format {fmt!r}")
    return OUTPUT_EXTENSION[fmt]

"""File catalogue: which files a job reads, in a fixed (sorted) order.

A single file is taken as given. A local or HDFS folder is listed
recursively with Spark's own file index (the ``binaryFile`` source with the
``content`` column pruned, so only names and sizes are read; large trees are
listed in parallel). A cloud prefix is globbed one level deep, as in the
reference. Extensions are matched ignoring case. Zero-length files hold no
rows (Spark's file index cuts no split for them), so they are kept apart: a
per-file job still makes an output for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ferry.functions.formats import (COMPRESSION_EXTENSIONS, INPUT_EXTENSIONS,
                                     file_format, is_data_file)
from ferry.functions.names import is_cloud
from ferry.sinks.fs import FileInfo, HadoopFS
from ferry.sources.readers import literal

_DATA_RE = (r"(?i)\.(" + "|".join(INPUT_EXTENSIONS) + r")(\.(" +
            "|".join(COMPRESSION_EXTENSIONS) + r"))?$")


class CatalogueError(ValueError):
    pass


@dataclass(frozen=True)
class Catalogue:
    root: str
    is_dir: bool
    files: tuple[FileInfo, ...] = field(default_factory=tuple)
    empty: tuple[FileInfo, ...] = field(default_factory=tuple)     # of length 0

    @property
    def paths(self) -> list[str]:
        return [f.path for f in self.files]

    @property
    def total_bytes(self) -> int:
        return sum(f.length for f in self.files)

    def formats(self) -> list[str]:
        return sorted({file_format(p) for p in self.paths})

    def first_format(self) -> str:
        return file_format((self.files or self.empty)[0].path)

    def check_same_format(self) -> str:
        """All files must share the first file's extension (merge mode)."""
        first = self.first_format()
        for p in self.paths:
            if file_format(p) != first:
                raise CatalogueError(f"files of different formats cannot be merged: {self.formats()}")
        return first


def find_input_files(spark: SparkSession, path: str) -> Catalogue:
    fs = HadoopFS(spark)
    if is_cloud(path) and is_data_file(path):
        found = tuple(fs.glob(path))
        return _apart(path, False, found) if found else Catalogue(path, False, (FileInfo(path, 0, False),))
    if fs.is_file(path):
        return _apart(path, False, [fs.status(path)])
    if is_cloud(path):
        listed = [f for f in fs.glob(path.rstrip("/") + "/*") if not f.is_dir]
        files = sorted((f for f in listed if is_data_file(f.path)), key=lambda f: f.path)
    elif fs.is_dir(path):
        listing = (spark.read.format("binaryFile")
                   .option("recursiveFileLookup", "true")
                   .load(literal(path))
                   .select("path", "length"))
        rows = listing.where(F.col("path").rlike(_DATA_RE)).orderBy("path").collect()
        files = [FileInfo(r.path, int(r.length), False) for r in rows]
        # the index also names files of length 0, of which no row is read
        known = {f.path for f in files}
        named = (fs.uri_to_path(p) for p in listing.inputFiles())
        files += [FileInfo(p, 0, False) for p in named if p not in known and is_data_file(p)]
    else:
        # A glob pattern on a local or HDFS path.
        files = sorted((f for f in fs.glob(path) if not f.is_dir and is_data_file(f.path)),
                       key=lambda f: f.path)
        if not files:
            raise CatalogueError(f"{path}: neither a data file nor a folder")
        return _apart(path, True, files)
    if not files:
        raise CatalogueError(f"{path}: no data files")
    return _apart(path, True, files)


def _apart(root: str, is_dir: bool, files) -> Catalogue:
    return Catalogue(root, is_dir, tuple(f for f in files if f.length > 0), tuple(f for f in files if f.length == 0))

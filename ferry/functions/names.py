"""Output naming rules (pure functions of names, no I/O)."""

from __future__ import annotations

import posixpath

from ferry.functions.formats import COMPRESSION_EXTENSIONS, basename

CLOUD_PREFIXES = ("gs://", "s3://", "s3a://", "s3n://", "abfs://", "abfss://", "wasbs://")


def is_cloud(path: str) -> bool:
    return path.startswith(CLOUD_PREFIXES)


def output_base_name(path: str) -> str:
    """File name minus one compression suffix, then minus the format suffix."""
    base = basename(path)
    for c in COMPRESSION_EXTENSIONS:
        if base.endswith("." + c):
            base = base[: -(len(c) + 1)]
            break
    if "." in base:
        base = base.rsplit(".", 1)[0]
    return base


def build_output_filename(base: str, ext: str, prefix: str = "", suffix: str = "",
                          compressed: bool = False) -> str:
    name = f"{prefix}{base}{suffix}.{ext}"
    return name + ".gz" if compressed else name


def chunk_filename(base: str, chunk_number: int, ext: str, prefix: str = "",
                   suffix: str = "", compressed: bool = False) -> str:
    """Chunk files are numbered from 1: ``<prefix><base>-<n><suffix>.<ext>``."""
    return build_output_filename(f"{base}-{chunk_number}", ext, prefix, suffix, compressed)


def fix_glob_name(name: str) -> str:
    # Fixed replacements for glob characters in merged names.
    return (name.replace("*", "merged").replace("?", "unknown")
                .replace("[", "").replace("]", ""))


def merged_filename(input_path: str, input_is_dir: bool, ext: str, prefix: str = "",
                    suffix: str = "", compressed: bool = False) -> str:
    """``<dir>_merged.<ext>``; no second ``merged`` when the name already has one."""
    if input_is_dir or is_cloud(input_path):
        base = fix_glob_name(basename(input_path.rstrip("/")))
    else:
        base = basename(input_path)
        if "." in base:
            base = base.rsplit(".", 1)[0]
    if "merged" not in base:
        base = base + "_merged"
    return build_output_filename(base, ext, prefix, suffix, compressed)


def default_output_dir(input_path: str, input_is_dir: bool) -> str:
    """Per-file outputs default to the folder the input file sits in."""
    if input_is_dir and not is_cloud(input_path):
        return input_path.rstrip("/")
    return posixpath.dirname(input_path.rstrip("/"))


def looks_like_file(path: str) -> bool:
    """An ``-o`` value whose last part has a dot is a file name, not a folder."""
    return "." in basename(path)


def join(dirname: str, name: str) -> str:
    return dirname.rstrip("/") + "/" + name if dirname else name

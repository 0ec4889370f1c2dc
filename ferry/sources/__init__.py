"""Sources: file catalogue, format readers, credentials."""

from ferry.sources.catalogue import Catalogue, find_input_files
from ferry.sources.readers import ReadOptions, read_files, SOURCE_COLS

__all__ = ["Catalogue", "find_input_files", "ReadOptions", "read_files", "SOURCE_COLS"]

"""JSON files that hold one array of objects, read in splits.

The file is read in pieces that end at ``}``, whatever its line breaks. Where a split
starts depends on what lies before it: inside a string or not, and how deep in
brackets. Each split is scanned once for both cases (a pass that returns one row
per split); following these rows through a file then gives each split's start. The
elements, objects at depth one, are cut out in scan order, and one that reaches
over a split boundary is put together from its pieces, as for CSV records.

An element is text again, so the readers for JSON lines (types, key order, dates)
apply to it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.functions.internal import PREFIX, SRC_BLOCK, SRC_FILE
from ferry.session import ship_package
from ferry.sources.csvrecords import (HEAD, INSIDE, KIND, RECORD, TAIL, VALUE, crossing_records, split_records,
                                      staged_starts, with_starts)

DEPTH, LAST = PREFIX + "depth", PREFIX + "last"
END = "}"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_OPEN = re.compile(r'"(?:[^"\\]|\\.)*\\?\Z', re.S)


def bare(piece: str, inside: bool) -> tuple[str, bool]:
    """(a piece without its strings, is its end inside a string)."""
    left = _STRING.sub("", f'"{piece}' if inside else piece)
    cut = _OPEN.search(left)
    return (left[:cut.start()], True) if cut else (left, False)


def _delta(text: str, closed: bool) -> int:
    return text.count("[") + text.count("{") - text.count("]") - text.count("}") - closed


class _Split:
    """The pieces of one split in order, cut into elements."""

    def __init__(self, file: str, block: int, inside: bool, depth: int):
        self.key, self.inside, self.depth, self.open, self.given = (file, block), inside, depth, [], 0
        self.kind = HEAD if inside or depth > 1 else RECORD

    def add(self, values, _):
        done, kinds = [], []
        for piece in values.to_pylist():
            text, inside = bare(piece, self.inside)
            after = self.depth + _delta(text, False)
            between = not self.open and self.kind == RECORD        # at the array's own level
            self.inside = inside
            if between and after <= 1 and not inside:
                # no element starts here: the array's end, or something that is no object
                if after == 1 or text.strip(" \t\r\n,\ufeff[]"):
                    raise ValueError(f"{self.key[0]}: the array holds elements that are no objects: {piece[:100]!r}")
                self.depth = 0
                continue
            if between:
                start = piece.index("{")
                if piece[:start].strip(" \t\r\n,\ufeff[") or piece[:start].count("[") != (self.depth == 0):
                    raise ValueError(f"{self.key[0]}: the array holds elements that are no objects: {piece[:100]!r}")
                piece = piece[start:]
            self.open.append(piece)
            self.depth = after - (not inside)       # the end mark closes a brace outside strings
            if not inside and self.depth == 1:
                done.append(END.join(self.open) + END)
                kinds.append(self.kind)
                self.open, self.kind = [], RECORD
        return done, np.array(kinds, np.int32)

    def rest(self):
        # every piece but a file's last was followed by an end mark
        return [(END.join(self.open) + END, HEAD if self.kind == HEAD else TAIL)] if self.open else []


def _starts(lines: DataFrame) -> DataFrame:
    """file, block, inside, depth of every split."""
    def scan(batches):
        import pyarrow as pa
        seen: dict[tuple, list] = {}
        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                # state and depth of both cases: started outside, started inside a string
                state = seen.setdefault((file, block), [False, 0, True, 0])
                for at in (0, 2):
                    text, state[at] = bare(value, state[at])
                    state[at + 1] += _delta(text, not state[at])
        rows = [(f, b, *s) for (f, b), s in seen.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
            [SRC_FILE, SRC_BLOCK, "in0", "deep0", "in1", "deep1"])

    def follow(group):
        """The splits of one file in order: one short row each."""
        import pyarrow as pa
        rows = sorted(zip(*(group.column(c).to_pylist() for c in (SRC_BLOCK, "in0", "deep0", "in1", "deep1"))))
        inside, depth, out = False, 0, []
        for block, *cases in rows:
            out.append((group.column(SRC_FILE)[0].as_py(), block, inside, depth))
            after, delta = cases[2:] if inside else cases[:2]
            inside, depth = after, depth + delta
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [SRC_FILE, SRC_BLOCK, INSIDE, DEPTH])

    place = f"{SRC_FILE} string, {SRC_BLOCK} long"
    splits = lines.select(VALUE, SRC_FILE, SRC_BLOCK).mapInArrow(
        scan, f"{place}, in0 boolean, deep0 long, in1 boolean, deep1 long")
    return splits.groupBy(SRC_FILE).applyInArrow(follow, f"{place}, {INSIDE} boolean, {DEPTH} long")


def elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every element of the arrays with its place: value, file, block and pos
    (increasing by one within a split). ``paths``: escaped file names."""
    ship_package(spark)
    df = spark.read.option("lineSep", END).text(paths)
    place = df.metadataColumn("_metadata")
    lines = df.select(F.col("value").alias(VALUE), place["file_path"].alias(SRC_FILE),
                      place["file_block_start"].alias(SRC_BLOCK), F.lit(0).alias(LAST))
    starts, n = staged_starts(spark, _starts(lines))
    marked = with_starts(lines, starts, n)
    found = split_records(marked, (RECORD,), LAST, [INSIDE, DEPTH], _Split).drop(KIND)
    pieces = split_records(marked, (HEAD, TAIL), LAST, [INSIDE, DEPTH], _Split)
    # a piece of an element already ends with its mark
    return found.unionByName(crossing_records(pieces, ""))

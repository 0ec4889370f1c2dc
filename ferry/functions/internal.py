"""Names of the columns that jobs add to the rows on their way.

They share a prefix that inputs and SQL results may not use: such a column is
refused before any work, so a user's column is never taken for one of ours.
"""

from __future__ import annotations

PREFIX = "__ferry_"

SRC_FILE = PREFIX + "file"        # the input file, as Spark names it
SRC_BLOCK = PREFIX + "block"      # start of the split in it
SRC_POS = PREFIX + "pos"          # increases within a split
FID = PREFIX + "fid"              # key of the output's input file
CHUNK = PREFIX + "chunk"          # chunk number from 0
IDX = PREFIX + "idx"              # row number
RUN, RUN_POS = PREFIX + "run", PREFIX + "run_pos"
RUN_N, RUN_P0, RUN_AT = PREFIX + "run_n", PREFIX + "run_p0", PREFIX + "run_at"
RUN_START, RUN_END = PREFIX + "run_start", PREFIX + "run_end"
RUN_LAST, RUN_ORDERED = PREFIX + "run_last", PREFIX + "run_ordered"
CORRUPT = PREFIX + "corrupt"

SOURCE_COLS = (SRC_FILE, SRC_BLOCK, SRC_POS)


class ReservedName(ValueError):
    pass


def refuse_reserved(columns: list[str], allowed: tuple[str, ...] = ()) -> None:
    taken = [c for c in columns if c.lower().startswith(PREFIX) and c not in allowed]
    if taken:
        raise ReservedName(f"column names starting with {PREFIX} are used by the job itself: {', '.join(taken)}")

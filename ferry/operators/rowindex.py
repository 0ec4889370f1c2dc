"""Dense row numbers 0..n-1 without moving rows to one task.

Rows are numbered within runs that Spark never splits: one input split
(file, split start) for tagged file scans, else one partition (per source
file when rows still carry it). A small per-run table — one row per split or
partition, so its size is bounded by the number of tasks, not by the data —
holds each run's row count and smallest position id; a running sum over it
gives each run's first row number. That table is joined back — broadcast
only when its measured size is under a limit, else by a shuffle join on the
run key — and each row adds its offset inside the run. No global sort and
no single-partition window over the data.

Both passes must see identical partitions: a plain file scan does; anything
behind a shuffle (dedupe, SQL) is checkpointed first to the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.functions.internal import (RUN, RUN_AT, RUN_END, RUN_LAST, RUN_N, RUN_ORDERED, RUN_P0,
                                      RUN_POS, RUN_START, SRC_BLOCK, SRC_FILE, SRC_POS)

# Broadcast the per-run offsets only below this many bytes (path text plus
# three longs per run); above it the offsets join by a shuffle on the run key.
MAX_BROADCAST_BYTES = 64 << 20


# Kept with ``keep_runs``: each row's run bounds, whether its run is the last
# one (of its file, or of everything), and whether rows kept scan order
# (offsets broadcast, so no shuffle moved them).
RUN_COLS = (RUN_START, RUN_END, RUN_LAST, RUN_ORDERED)


def with_row_index(df: DataFrame, name: str = "_idx", per_file: bool = False,
                   stable: bool | None = None,
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                   keep_runs: bool = False) -> DataFrame:
    """Add ``name`` = 0-based row number in input order.

    With source tags (``read_files(tag=True)``) the order is file order:
    files by path, then split start, then position in the split. ``per_file``
    restarts numbering at 0 in every file. ``keep_runs`` also keeps
    RUN_COLS (see above).
    """
    if name in df.columns:
        raise ValueError(f"there already is a column {name}")
    scan_tags = all(c in df.columns for c in (SRC_FILE, SRC_BLOCK, SRC_POS))
    has_file = SRC_FILE in df.columns
    if stable is None:
        stable = scan_tags
    if not stable:
        df = df.checkpoint(eager=True)
    if scan_tags:
        run_keys = [SRC_FILE, SRC_BLOCK]
        pos = F.col(SRC_POS)
        work = df
        extra = []
    else:
        if per_file and not has_file:
            raise ValueError("per-file numbering needs the source file column")
        work = (df.withColumn(RUN, F.spark_partition_id())
                  .withColumn(RUN_POS, F.monotonically_increasing_id()))
        run_keys = ([SRC_FILE] if has_file else []) + [RUN]
        pos = F.col(RUN_POS)
        extra = [RUN, RUN_POS]

    runs = work.groupBy(*run_keys).agg(F.count(F.lit(1)).alias(RUN_N), F.min(pos).alias(RUN_P0))
    if per_file:
        order = Window.partitionBy(SRC_FILE).orderBy(*run_keys[1:])
    else:
        order = Window.orderBy(*run_keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = (runs.withColumn(RUN_AT, F.coalesce(F.sum(RUN_N).over(before), F.lit(0)))
                .withColumn(RUN_LAST, F.lead(RUN_N).over(order).isNull()))
    runs = runs.select(*run_keys, RUN_AT, RUN_P0, RUN_N, RUN_LAST).checkpoint(eager=True)
    text = F.sum(F.length(SRC_FILE)) if SRC_FILE in run_keys else F.lit(0)
    n_runs, n_text = runs.agg(F.count(F.lit(1)), text).collect()[0]
    broadcast = (n_text or 0) + 32 * n_runs <= max_broadcast_bytes
    runs = F.broadcast(runs) if broadcast else runs.hint("shuffle_hash")
    out = work.join(runs, on=run_keys, how="inner")
    out = out.withColumn(name, (F.col(RUN_AT) + pos - F.col(RUN_P0)).cast("long"))
    if keep_runs:
        out = (out.withColumn(RUN_START, F.col(RUN_AT))
                  .withColumn(RUN_END, F.col(RUN_AT) + F.col(RUN_N) - 1)
                  .withColumn(RUN_ORDERED, F.lit(broadcast)))
        if not scan_tags:
            # A partition run of stable (checkpointed) rows plays the part of
            # an input split: writers can then lay out chunks per run, in
            # order, without another shuffle.
            out = (out.withColumn(SRC_BLOCK, F.col(RUN).cast("long"))
                      .withColumn(SRC_POS, F.col(RUN_POS)))
    else:
        out = out.drop(RUN_LAST)
    return out.drop(RUN_AT, RUN_P0, RUN_N, *extra)

"""Apply reshaping steps with the reference's failure policy.

Steps are checked by Spark's analyzer when the plan is built, before any
job runs. A step that does not fit the data (wrong type, bad regex) warns
and leaves the rows untransformed; ``strict=True`` raises instead.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from ferry.functions.jsonsteps import Chain, Step, steps_from_list

log = logging.getLogger("ferry")


def as_chain(steps) -> Chain | None:
    if steps is None:
        return None
    if isinstance(steps, Chain):
        return steps
    if isinstance(steps, Step):
        return Chain((steps,))
    return steps_from_list(list(steps))


def apply_steps(df: DataFrame, steps, strict: bool = False) -> tuple[DataFrame, bool]:
    """Returns (DataFrame, applied?)."""
    chain = as_chain(steps)
    if chain is None or not chain.steps:
        return df, True
    try:
        out = chain.apply(df)
        out.schema  # force analysis now
        return out, True
    except (AnalysisException, PySparkException, ValueError) as e:
        if strict:
            raise
        log.warning("steps not applied, rows pass through as they are: %s", e)
        return df, False

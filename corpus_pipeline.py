"""A training-data pipeline over ``documents``: five stages, each an operator of
``ferry.llm``, each written as Parquet and read again by the next.

1. language_id: documents whose language is unknown go.
2. near_dedup: of each class of near-duplicates the document with the smallest id stays.
3. pii: personal data in the texts is replaced by its kind.
4. mixing: documents are repeated so that sources meet their target weights.
5. sentencepiece: every row becomes token ids.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of ``documents``. SQL cannot express the first stage, so there is no oracle;
tests compare the stages with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferry.llm import langid, mixing, neardup, pieces, pii
from ferry.llm.common import DOC_COLUMNS, staged, table

STAGES = [
    ("language_id", langid.keep_known),
    ("near_dedup", neardup.keep_one),
    ("pii", pii.redact_stage),
    ("mixing", mixing.mix_stage),
    ("sentencepiece", pieces.encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(DOC_COLUMNS)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

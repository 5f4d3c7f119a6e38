"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept;
its output is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nightjar.llm import bpe, common, decontaminate, pii, quality, simhash
from nightjar.llm.registry import pinned

STAGES = [
    ("quality", pinned(quality.stage_quality)),
    ("near_duplicates", pinned(simhash.stage_near_duplicates)),
    ("decontamination", pinned(decontaminate.stage_decontaminate)),
    ("personal_data", pinned(pii.stage_personal_data)),
    ("tokens", pinned(bpe.stage_bpe)),
]

#: No stage can be written in SQL: the first needs two tokenizers' vocabularies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each over the written result of the one before."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

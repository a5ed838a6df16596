"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import decontam, langid, mixing, neardup, toxicity
from strandgraph.llm.common import materialize, table

STAGES = [
    ("language_id", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: SQL can't express trained classifiers. tests/llm compares scores with plain forward passes, near-duplicates with all pairs,
#: and decontamination and mixing with SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to packed token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline as steps
from tidemark.llm.shared import stage

STAGES = [
    ("toxicity", steps.drop_toxic),
    ("near_dedup", steps.drop_near_copies),
    ("decontaminate", steps.drop_leaks),
    ("mix", steps.mix_sources),
    ("pack_tokens", steps.pack_tokens),
]

#: No SQL can train a classifier or run a tokenizer; tests/llm holds the operators against brute force, held-out labels and round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

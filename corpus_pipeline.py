"""The corpus pipeline: STAGES applied to documents one after another.

toxicity: documents scored as toxic go.  language: documents whose language
can't be told go.  near_duplicates: one document of each group stays.
packing: what is left becomes sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import stages
from lodestar.llm.common import documents, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language", stages.drop_unknown_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("packing", stages.pack),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

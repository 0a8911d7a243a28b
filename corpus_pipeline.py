"""A training corpus from documents: rules, near-dedup, decontamination, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import stages
from tidewrack.llm.common import cut, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("mixing_to_weights", stages.mixing_to_weights),
    ("token_output", stages.token_output),
]

#: Sketches, spaced seeds and the tokenizer have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

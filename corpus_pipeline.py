"""The corpus pipeline: language ID, line dedup, near duplicates, source mix and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.best_fit_packing import packing_stage
from tidemark.llm.common import materialize
from tidemark.llm.language_id import language_stage
from tidemark.llm.line_dedup import line_dedup_stage
from tidemark.llm.ngram_jaccard import near_duplicate_stage
from tidemark.llm.source_mix import mixing_stage

STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The learned profiles, hashed boundaries and tokenizer have no SQL form; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

"""The corpus pipeline: stages over documents, each written as Parquet and read again.

1. language: documents without a language go.
2. exact_dedup: of equal texts (ASCII case apart) the one with the largest id stays.
3. near_dedup: of each component of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays.
4. decontaminate: documents that hold a passage of the benchmark go.
5. pack: what is left is packed into sequences of 2048 tokens; one row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetable.llm import decontaminate, exact_dedup, jaccard, language, packing
from kinetable.llm.queries import tokenizer_path
from kinetable.llm.shared import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: Learned models, edit distances and a tokenizer: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result having been written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs

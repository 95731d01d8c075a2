"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing and BPE.

Every stage takes (spark, docs, sf_dir), docs with the columns of the table documents, and returns a DataFrame; all but the last
return the same columns. Stages are written as Parquet and reread, so each starts from stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import op1_repetition, op4_bpe, op6_simhash, op9_mixing, op10_content_sort
from fieldloom.llm.common import tokenizer_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return op1_repetition.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then the one with the smallest id, stays."""
    return op10_content_sort.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one with the smallest id."""
    return op6_simhash.keep_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return op9_mixing.materialise(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text for each row of the mix."""
    return op4_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", bpe),
]

#: SQL has no XXH64 and no BPE; a brute-force version in tests/llm stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs

"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, and token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. ``run`` writes each
stage's result below the shared folder and reads it back as the next one's
input, so a lost executor costs one stage's tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, line_dedup, quality, simhash, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the current policy rejects go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that repeat an earlier line, or nearly, go; n_chars follows."""
    store.tuned(spark)
    return line_dedup.remove_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays; fingerprints group first, shingle sets check and complete the groups."""
    store.tuned(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    store.tuned(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document's ids, encoded and decoded again."""
    store.tuned(spark)
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontaminate", decontaminated),
    ("bpe", token_ids),
]

#: No SQL: lines' similarity, fingerprints and byte-pair merges are beyond it. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            store.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

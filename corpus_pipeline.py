"""From raw documents to packed training windows: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corollary.llm import common, decontaminate, exact_dedup, near_dup, packing, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, common.table(spark, sf_dir, "labels"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.near_dedup(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("minhash_near_dedup", remove_near_copies),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("packing", pack_windows),
]

#: Neither a trained model nor an automaton over tokens nor a packing plan can be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet and read again as the next one's docs."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stage(docs, f"pipeline-{name}")
    return docs

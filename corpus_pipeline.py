"""A training-data pipeline of five stages, each by one operator of gridspark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontamination, ngramjoin, packing, quality, secrets
from gridspark.llm.queries import vocabulary
from gridspark.llm.workspace import new_path, remove


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngramjoin.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; all documents stay."""
    return secrets.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written as Parquet and read again.

    A stage's table goes when the next one's is whole. Nulls, empty and repeated rows
    are as each stage's operator says; an empty table gives no piece.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs


#: A fitted model, token ids and greedy packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

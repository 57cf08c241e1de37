"""Stages that turn documents into packed training bins.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows, no rows, and further columns of any name, which all but the last
hand on as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import packing, quality, simhash, suffix_dedup, toxicity
from quillspark.llm.frames import shared_dir


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the labels in sf_dir teach what is toxic.

    Null and empty texts stay, repeated rows are judged each; without labels
    nothing goes.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves go; null, empty and short texts stay, repeated rows are judged each."""
    return quality.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the least id's; of repeated rows one. Null and empty texts stay."""
    return simhash.drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage that repeats stays at its first place alone, and n_chars follows; a document without words left goes. Null and empty texts stay."""
    return suffix_dedup.cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left, by their ids; null, empty and blank texts are in none, long ones in several."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_passages),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet to a new folder below spark.checkpoint.dir and read again.

    The folder stays, as the result is read from it; without documents there is
    no bin.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}_{name}")
        docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return docs

"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ann, bpe, licenses, lm, packing, quality, simhash, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 50 words and more that occur twice in all documents; see repeated_passages() for nulls, empties and repeats."""
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of all for each row whose id 50 divides; see nearest() for vectors that don't count, ties and repeats."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=ann.QUERY_EVERY)


def toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic passages and the chance of every document, learned from labels; see fit() and toxic_report() for nulls, empties and repeats."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic_report(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and whether they decode to it; see encode_documents() for nulls, empties and repeats."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under all the others; see score() for nulls, empties and repeats."""
    return lm.score(_table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents; see license_spans() for nulls, empties and repeats."""
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document repeats itself; see repetition_report() for nulls, empties and repeats."""
    return quality.repetition_report(_table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words of all documents; see pack() for nulls, empties, repeats and long texts."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents; see near_duplicates() for nulls, empties and repeats."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of all pages' files, rewritten record by record; see normalise_pages() for nulls, empties and repeats."""
    return warc.normalise_pages(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_suffix_array_dedup": suffix_array_dedup,
    "op2_nearest_neighbours": nearest_neighbours,
    "op3_toxicity": toxic_passages,
    "op4_byte_bpe": byte_bpe,
    "op5_lm_scoring": lm_scoring,
    "op6_license_scan": license_scan,
    "op7_quality_rules": quality_rules,
    "op8_best_fit_packing": best_fit_packing,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_warc": warc_members,
}

#: None of these is expressible in SQL over whole tables; tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {}

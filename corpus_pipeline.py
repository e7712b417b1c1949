"""A corpus pipeline in five stages, each an operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from sonoframe.llm.common import fresh_path, keep


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    model = quality_classifier.train(docs, quality_classifier.taught(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality_classifier.good(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_exact_duplicates(docs, exact_dedup.DigestIndex(spark, fresh_path(spark, "digest-index")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each use."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, bpe.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("bpe", encoded),
]

#: A trained network and hashed fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""From raw documents to packed training sequences: five stages, each a written table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import exact_dedup, near_dedup, packing, quality_knn, source_mix
from sightline.llm.common import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours call good."""
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id.

    Stages without a contract take five words; the query op10_near_dedup takes four, as its contract says.
    """
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice is there twice."""
    return source_mix.mix(docs, carry=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("source mix", mixed),
    ("best-fit packing", packed),
]

#: The classifier, the signatures and the tokenizer have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder, where the application's other tables lie, before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}-{name.replace(' ', '-')}")
    return docs

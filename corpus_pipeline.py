"""The corpus pipeline: documents to the token ids of a mixed, filtered training set.

Each stage takes the documents that its predecessor kept and returns a
DataFrame with the columns of ``documents``; the last returns the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simlattice.llm import bpe, cotrain, jaccard, mixing, rules
from simlattice.runtime import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current version of the rules."""
    return rules.ledger(docs).filter(rules.passes(rules.CURRENT)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views accept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classified(docs, labels).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_per_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of the ids and of the text they decode to."""
    return bpe.digests(docs, bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", source_mix),
    ("BPE encoding and decoding", encoding),
]

#: The classifier, the join and the encoding have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as a table and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

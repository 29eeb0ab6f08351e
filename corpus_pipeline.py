"""Corpus pipeline: documents through quality, rules, near-duplicate and passage removal to packed sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all documents that its predecessor has
kept, and returns a DataFrame that is written as Parquet and read again for the next one.

Defined results, for every stage: a null text is an empty one, and empty texts fail the quality rules; a null source is a
source of its own; rows without an id are documents of their own, of which one of each wording stays; of rows that repeat
an id and wording one stays; of near copies the smallest id stays; texts of any length are worked on whole; without
labels of both kinds all documents pass the classifier; empty tables give empty tables; other columns, whatever their
names, pass through all stages but the last, and ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, groupjoin, lines, packing, quality, substring
from tallyloom.llm.common import let_go, settled


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have shortened."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones, accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7, modulus=4)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines that many documents of a source share."""
    return _recounted(lines.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of smallest id."""
    return groupjoin.deduplicate(docs, shingle=5, percent=75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that start earlier elsewhere."""
    return _recounted(substring.deduplicate(docs, window=20))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids."""
    return packing.pack(docs, bpe.default_vocabulary(), length=4096, end=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: Learned rules, token ids and packing are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder; what a stage needs on its way goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        let_go(spark, *before)
        before = [docs]
    return docs

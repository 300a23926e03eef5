"""From raw documents to packed sequences: five of the training-data operators in a row."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import decontam, linededup, neardup, packing, quality
from mensura.llm.shared import narrowed, stage
from mensura.session import reachable, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the boilerplate lines of their site; documents of nothing else stay as they are, as
    copies have all their lines in common: the next stage keeps one of each."""
    packed, columns = narrowed(docs, "text", "source", "n_chars")  # columns named as the operator's own stay
    cleaned = linededup.clean(packed, whole=True)
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return neardup.representatives(docs, 5, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end=1, keep_ids=False)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
# SQL has neither the fitted models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

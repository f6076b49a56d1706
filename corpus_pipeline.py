"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents. Ids that the
mix repeats stay repeated rows. No stage looks at a row's place or id to decide, beyond what its operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailgraph.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from mailgraph.llm.registry import documents
from mailgraph.plans import lineage


def ordinary_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression-distance classifier calls toxic; it learns from the labelled rows among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each set of equal texts."""
    return exact_dedup.keep_one(docs)


def first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_first(docs, shingle=5)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources reach their target weights."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", ordinary_texts),
    ("exact dedup", distinct_texts),
    ("near dedup", first_of_similar),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
#: compression lengths, MinHash and tokenizers have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = lineage.cut(docs)
    return docs

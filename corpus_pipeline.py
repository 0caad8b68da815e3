"""Documents to packed training sequences, as five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns they got: the quality
classifier drops what it rejects, exact and near dedup keep one document of each group, and the mix repeats
documents to meet the targets of their sources.  The last returns the place of every piece in its sequence.
A table without rows, or with null texts, ids or sources, passes through all stages as the
operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import chosen_path, exact, mixing, packing, quality
from pricewright.llm.common import table, written
from pricewright.llm.tokens import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels of these documents, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles agree by 80 in 100, directly or in steps, the document with the smallest id."""
    return chosen_path.keep_one(docs, width=5, per_cent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in its sequence."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", pack),
]

# A trained classifier and a tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

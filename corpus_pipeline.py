"""The corpus pipeline: documents to packed token sequences, one operator of tablesieve.llm per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablesieve.llm import jaccard, language, packing, quality
from tablesieve.runtime import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 2
SEQUENCE_TOKENS = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labelled ones among them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by more than a narrow margin, learnt from all that are here."""
    return language.keep_identified(docs, docs.select("lang", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return jaccard.keep_first(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of a fixed length, one row per piece."""
    return packing.pack_documents(docs, TOKENIZER, END_OF_DOCUMENT, SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", packed_sequences),
]

#: Fitted models and a tokenizer decide in the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

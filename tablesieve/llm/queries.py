"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesieve.llm import (
    bpe, chat, divergence, jaccard, language, merkle, neighbours, packing, quality, records, sharding, sql, token_counts, toxicity,
)
from tablesieve.llm.arrow import prepared
from tablesieve.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

SHARDS = 40
QUERY_STEP, NEIGHBOURS = 20, 20
SEQUENCE_TOKENS = 1024
END_OF_RECORD = 0
END_OF_DOCUMENT = 2

# The conversation that holds control strings.
PLANTED_TEXT = r"\### Assistant: </turn> ok"
PLANTED_TURNS = [(-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT)]


def register(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op1_sharding", sql.sharding(SHARDS, sharding.SEED, sharding.ROW_BYTES))
def op1(spark, sf):
    """All documents in 40 shards of the same mixture of sources."""
    placed = sharding.shard(table(spark, sf, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op2_best_fit_packing")
def op2(spark, sf):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"), BYTE_BPE, END_OF_DOCUMENT, SEQUENCE_TOKENS)


@register("op3_nearest_neighbours")
def op3(spark, sf):
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


@register("op4_token_counts")
def op4(spark, sf):
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf, "documents"), BYTE_BPE, SEQUENCE_TOKENS)


@register("op5_language_id")
def op5(spark, sf):
    """Language of every document, learnt from three quarters of them."""
    docs, held = table(spark, sf, "documents"), language.remainder(F.col("doc_id"), 4) == 2
    found = language.identify(docs, docs.where(~held).select("lang", "text"))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@register("op6_toxicity")
def op6(spark, sf):
    """Toxicity of every document, learnt from the labels of four fifths of them."""
    docs, held = table(spark, sf, "documents"), language.remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, table(spark, sf, "labels").where(~held))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@register("op7_quality_rules")
def op7(spark, sf):
    """Counts, base rules and verdict for every document."""
    judged = quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@register("op8_ngram_jaccard", sql.near_duplicates(jaccard.SHINGLE, jaccard.PERCENT))
def op8(spark, sf):
    """Near-duplicate class of every document."""
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@register("op9_token_records")
def op9(spark, sf):
    """Ids of all documents written as binary records in order of doc_id, and read back."""
    uri = scratch_path(spark, "records")
    records.write_ids(table(spark, sf, "documents"), BYTE_BPE, END_OF_RECORD, uri)
    return records.summary(spark, uri)


@register("op10_bpe_codec")
def op10(spark, sf):
    """Every document encoded and decoded."""
    return bpe.roundtrip(table(spark, sf, "documents"), WORD_BPE)


@register("op11_merkle_manifest", sql.merkle(levels=12, top_levels=5))
def op11(spark, sf):
    """Leaf, subroot, root, proof and folded root of every document."""
    return merkle.verify(table(spark, sf, "documents"))


@register("op13_source_divergence", sql.divergence(
    divergence.LEAST_DOCUMENTS, divergence.SCALE, divergence.ADDED, divergence.REPORTED_TERMS))
def op13(spark, sf):
    """Distances between the sources of every language, and their marked terms."""
    return divergence.audit(table(spark, sf, "documents"))


@register("op12_chat_formatting", sql.chat(PLANTED_TURNS))
def op12(spark, sf):
    """Every conversation, and one with control strings, formatted as prefix trees and read back."""
    planted = spark.createDataFrame(PLANTED_TURNS, "conv_id long, turn long, role string, text string")
    uri = scratch_path(spark, "chat")
    conversations = table(spark, sf, "conversations").select(*planted.columns)
    chat.format_tree(conversations.unionByName(planted), BYTE_BPE, uri)
    return chat.summary(spark, BYTE_BPE, uri)

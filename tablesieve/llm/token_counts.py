"""Token counts: batches of texts are encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesieve.llm import arrow
from tablesieve.llm.encoding import library_tokenizer

BATCH_BYTES = 1 << 19

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@functools.cache
def json_lengths(path: str):
    library = library_tokenizer(path)
    return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def model_lengths(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def lengths_of(path: str):
    """Counts the tokens of a list of texts with the library the file belongs to."""
    return model_lengths(path) if path.endswith(".model") else json_lengths(path)


def balanced(texts: list[str], split: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (owner, part) of about equal bytes; long texts come in parts cut at safe boundaries."""
    owners, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for part in arrow.chunks(text, BATCH_BYTES // 4) if split else [text]:
            owners.append(number)
            parts.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = lengths_of(path)
    # a sentencepiece model sees a text as a whole: its pieces may span spaces
    split = not path.endswith(".model")
    for rows in batches:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        totals = [0] * len(texts)
        for owners, parts in balanced(texts, split):
            for owner, n in zip(owners, count(parts), strict=True):
                totals[owner] += n
        yield arrow.batch(SCHEMA, [rows.column(0), [len(t.encode()) for t in texts], totals])


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a tokenizer file every worker can read: ``.json`` is counted by the tokenizers library,
    ``.model`` by sentencepiece. One row comes out for each row that goes in; nothing is shuffled, and other
    columns, whatever their names, are not read. A missing or empty text has 0 bytes and 0 tokens; a
    missing key stays missing; repeated rows are counted each; an empty table gives an empty one. Texts
    of any length are encoded in parts of bounded size, unless they have no space to cut at.
    """
    arrow.prepared(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    counted = rows.mapInArrow(lambda it: count_batches(it, path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

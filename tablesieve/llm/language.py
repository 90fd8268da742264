"""Language of whole texts by compression: the language whose dictionary makes a text smallest.

Each language gets a raw-content zstandard dictionary of its training texts. A text is compressed in parts, so that
what it has said before cannot take the place of the dictionary, once per language; sizes are summed over the
whole text. A narrow margin between the two smallest sizes is a reason to reject the prediction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.llm import arrow

UNKNOWN = "und"
MARGIN = 0.01

#: The training sample: labelled rows of each language, and the characters of a dictionary that each of them fills.
SAMPLE_TEXTS = 96
TEXT_CHARS = 1200
#: A longer text fills its share with parts of so many characters from all of it.
SPREAD_CHARS = 200

LEVEL = 7
PART_BYTES = 2048

LETTER = regex.compile(r"\p{L}")
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
)
COLUMNS = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def remainder(key: Column, by: int) -> Column:
    """CRC-32 of the key as text, modulo ``by``; a missing key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def spread_parts(text: Column) -> Column:
    """A text of at most ``TEXT_CHARS``, or as much of a longer one: parts at even distances, the first and the last included."""
    parts = TEXT_CHARS // SPREAD_CHARS
    room = F.length(text) - SPREAD_CHARS
    start = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor(i * room / (parts - 1)).cast("int") + 1)
    listed = F.transform(start, lambda at: F.substring(text, at, F.lit(SPREAD_CHARS)))
    return F.when(F.length(text) <= TEXT_CHARS, text).otherwise(F.array_join(listed, "\n"))


def training_texts(known: DataFrame) -> dict[str, list[str]]:
    """A bounded sample of the texts of each language in known(lang, text): ``SAMPLE_TEXTS`` of them, by ``spread_parts``.

    The hash of a text names its bucket and decides which text of the bucket is taken, so copies count once, a
    language of any size is reduced before the shuffle, and the sample depends on the texts alone.
    """
    spread = F.xxhash64("text")
    rows = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", spread.alias("h"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("bucket")).agg(F.min("h").alias("h"))
    # at most SAMPLE_TEXTS rows per language
    picked = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"])
    parts = picked.select("lang", "h", spread_parts(F.col("text")).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found: dict[str, list[str]] = {}
    for row in parts.orderBy("lang", "h").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["text"])
    return found


def dictionaries(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionary bytes of each language, those with most text first: they win where sizes are equal."""
    joined = {lang: "\n".join(t).lower().encode("utf-8") for lang, t in texts.items()}
    return {lang: joined[lang] for lang in sorted(joined, key=lambda k: (-len(joined[k]), k))}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.languages = list(contents)
        self.compressors = []
        for content in contents.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        data = text.lower().encode("utf-8")
        parts = [data[i : i + PART_BYTES] for i in range(0, max(1, len(data)), PART_BYTES)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score in [0, 1], margin between the two best, and whether that margin is too narrow."""
        if not text or not self.languages or LETTER.search(text) is None:
            return UNKNOWN, 0.0, 0.0, True
        sizes = np.array(self.sizes(text), float)
        order = np.argsort(sizes, kind="stable")
        score = 1.0 / np.exp(np.clip(sizes.min() - sizes, -700, 0)).sum()
        margin = 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
        return self.languages[order[0]], float(score), float(margin), bool(margin < MARGIN)


@functools.lru_cache(maxsize=2)
def classifier(contents: tuple[tuple[str, bytes], ...]) -> Classifier:
    """The worker's classifier, kept from task to task."""
    return Classifier(dict(contents))


def predict_batches(batches: Iterator[pa.RecordBatch], contents: tuple[tuple[str, bytes], ...]) -> Iterator[pa.RecordBatch]:
    model = classifier(contents)
    for rows in batches:
        found = [model.predict(t) for t in rows.column(1).to_pylist()]
        yield arrow.batch(SCHEMA, [rows.column(0), *(map(list, zip(*found)) if found else [[]] * 4)])


def identify(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text of ``docs``, learnt from ``known(lang, text)``: ``COLUMNS``.

    One row comes out per row that goes in; only key and text are read. A missing text, or one without a letter, is
    ``und`` with score 0 and rejected; so is everything when no language is known. Equal sizes go to the
    language with more training text and are rejected as narrow. Missing keys stay missing, repeated rows get
    equal results, long texts are compressed part by part, an empty table gives an empty one. A dictionary has
    ``SAMPLE_TEXTS`` times ``TEXT_CHARS`` characters at most, in every worker.
    """
    arrow.prepared(docs.sparkSession)
    contents = tuple(dictionaries(training_texts(known)).items())
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: predict_batches(it, contents), COLUMNS)


def keep_identified(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told by more than a narrow margin, with all their columns."""
    arrow.prepared(docs.sparkSession)
    contents = tuple(dictionaries(training_texts(known)).items())

    def passes(texts: list[bytes | None]) -> list[bool]:
        model = classifier(contents)
        return [not model.predict(t.decode("utf-8") if t else None)[3] for t in texts]

    return arrow.kept_rows(docs, text, passes)

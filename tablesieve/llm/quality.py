"""Quality rules: counts over whole texts, two fixed rules, and boosted trees over the counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesieve.llm import arrow, trees

# Characters that count as symbols, and the rules every kept text passes.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Most labelled documents the trees are fitted on: those whose hashed ids are smallest.
MOST_LABELLED = 20_000
KEPT_SCORE = 0.5

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits",
    "n_marks", "n_bars",
]
LABELLED = pa.schema([("label", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
JUDGED = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("score", pa.float64()), ("base_failed", pa.bool_()),
     ("kept", pa.bool_())]
)

#: Feature and the way the score may go with it: -1 may not rise, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "words_a_line": 0, "distinct": 0,
    "upper": 0, "digits": 0, "marks": -1, "bars": -1,
}

SPACES = bytes([0x20, *range(0x09, 0x0E)])
CONTINUED = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(words, range(n)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if n < 1 << 21:
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= found
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """Counts of one text in UTF-8, in the order of ``COUNTS``."""

    def number(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    words = text.split()  # of bytes: at exactly the white space of the contract
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - number(SPACES) - number(CONTINUED),
        number(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        number(UPPER),
        number(DIGITS),
        number(b"!?"),
        number(b"|"),
    )


def features(table: dict[str, np.ndarray]) -> np.ndarray:
    """Features of counted documents, one row each, in the order of ``FEATURES``."""
    c = {k: np.asarray(table[k], float) for k in COUNTS}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), chars / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words, words / lines, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
            c["n_marks"] / words, c["n_bars"] / words,
        ],
        axis=1,
    )


def counted(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of a batch of texts; a missing text counts as empty."""
    rows = np.array([counts(t or b"") for t in texts], np.int64).reshape(-1, len(COUNTS))
    return dict(zip(COUNTS, rows.T, strict=True))


def base_failed(table: dict[str, np.ndarray]) -> np.ndarray:
    words, repeats = table["n_words"], table["n_repeat_words"]
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * words)


def labelled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        table = counted(rows.column(1).to_pylist())
        found = arrow.batch(LABELLED, [rows.column(0), *table.values()])
        yield found.filter(pa.array(~base_failed(table)))


def fit_forest(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> trees.Forest:
    """Trees for labels(doc_id, quality), on at most ``MOST_LABELLED`` labelled documents; those that fail the base rules
    are left to these.

    Rows without id or label take no part. Without labels of both kinds, every document scores alike.
    """
    arrow.prepared(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("label"))
    known = known.dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("text"))
    # the chosen rows are few by their bound
    sample = rows.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("long"), "text")
    found = sample.mapInArrow(labelled_batches, ", ".join(f"{f.name} long" for f in LABELLED)).toPandas()
    found = found.sort_values(list(found.columns))
    return trees.fit(features(found), found["label"].to_numpy(float), list(FEATURES.values()))


def judge_batches(batches: Iterator[pa.RecordBatch], forest: trees.Forest) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        table = counted(rows.column(1).to_pylist())
        score, failed = forest.score(features(table)), base_failed(table)
        yield arrow.batch(JUDGED, [rows.column(0), *table.values(), score, failed, ~failed & (score >= KEPT_SCORE)])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``COUNTS``, ``score``, ``base_failed``, ``kept`` for every document.

    The trees are fitted on a bounded labelled sample; then every whole text is counted and scored where it is,
    one row per row that goes in. Missing and empty texts fail the base rules; missing keys stay missing; repeated
    rows are judged alike; an empty table gives an empty one; without usable labels the base rules decide alone.
    Other columns are not read.
    """
    forest = fit_forest(docs, labels, key, text)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("text"))
    columns = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS])
    return rows.mapInArrow(
        lambda it: judge_batches(it, forest), columns + ", score double, base_failed boolean, kept boolean"
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    forest = fit_forest(docs, labels, key, text)

    def passes(texts: list[bytes | None]) -> list[bool]:
        table = counted(texts)
        return list(~base_failed(table) & (forest.score(features(table)) >= KEPT_SCORE))

    return arrow.kept_rows(docs, text, passes)

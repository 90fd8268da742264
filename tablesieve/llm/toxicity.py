"""Toxicity by a linear classifier that must not care which group a sentence names.

Features are the words of a text and the first letters of longer words. Besides the logistic loss on labelled texts, the
fit pays for every change of score when an identity term in a labelled text is swapped for another term of its group:
what is neutral about one group is neutral about all. Each group holds a neutral word too, which draws the
weights of its terms to that of an ordinary word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tablesieve.llm import arrow
from tablesieve.runtime import materialize

#: Bound of the fit: labelled documents (those whose hashed ids are smallest).
MOST_LABELLED = 12_000
#: A feature takes part if so many of these have it, it is by so much more frequent with one label, and its chi-square test says so.
LEAST_TEXTS = 2
LEAST_LOG_ODDS = 1.0
LEAST_CHI2 = 10.83

PREFIX = 5
RATE, STEPS, L2, SWAP_WEIGHT = 0.1, 300, 1e-4, 1.0

#: Terms that can stand for each other, the neutral ones first. A parameter of the fit.
IDENTITY_GROUPS = (
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("person", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("people", "women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("person", "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("person", "black", "white", "asian", "african", "latino", "latina", "hispanic", "arab", "european"),
    ("people", "immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("person", "immigrant", "refugee", "foreigner", "migrant", "native", "citizen"),
    ("person", "disabled", "blind", "deaf", "elderly", "old", "young"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge"),
)

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
FOUND = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.string()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a whole text, which is searched in parts of bounded size."""
    found: set[str] = set()
    for part in arrow.chunks(text):
        found.update(WORD.findall(part.lower()))
    return found


def features_of(words: set[str]) -> set[str]:
    """Words, and ``*`` with the first letters of words longer than ``PREFIX``."""
    return words | {"*" + w[:PREFIX] for w in words if len(w) > PREFIX}


def swaps(words: set[str], groups) -> Iterator[set[str]]:
    """Features of the text with each identity term swapped for the next term of its group, and for the neutral one."""
    for group in groups:
        for place, term in enumerate(group):
            if term in words:
                for other in {group[(place + 1) % len(group)], group[0]} - {term}:
                    yield features_of((words - {term}) | {other})


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [sorted(features_of(words_of(t or ""))) for t in rows.column(2).to_pylist()]
        yield arrow.batch(FOUND, [rows.column(0), rows.column(1), found])


def telling_features(sample: DataFrame) -> list[str]:
    """All features of sample(doc_id, label, text) that tell the labels apart; the sample bounds their number."""
    found = sample.mapInArrow(feature_batches, "doc_id long, label int, features array<string>")
    sizes = sample.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).first()
    p, q = float(sizes["p"] or 0), float(sizes["q"] or 0)
    if not p or not q:
        return []
    seen = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (q + 1))
    chi2 = (p + q) * F.pow(a * (q - b) - b * (p - a), 2) / (p * q * (a + b) * (p + q + 1 - a - b))
    telling = seen.where((a + b >= LEAST_TEXTS) & (F.abs(odds) >= LEAST_LOG_ODDS) & (chi2 >= LEAST_CHI2))
    return [r["feature"] for r in telling.select("feature").orderBy("feature").collect()]


def place_batches(batches: Iterator[pa.RecordBatch], names: list[str], groups) -> Iterator[pa.RecordBatch]:
    """Per text the places of its features, and for each swap the places of the features of the swapped text."""
    place = {n: i for i, n in enumerate(names)}
    schema = pa.schema([("label", pa.int32()), ("own", pa.list_(pa.int32())), ("swapped", pa.list_(pa.list_(pa.int32())))])

    def places(found: set[str]) -> list[int]:
        return sorted(place[f] for f in found & place.keys())

    for rows in batches:
        words = [words_of(t or "") for t in rows.column(2).to_pylist()]
        own = [places(features_of(w)) for w in words]
        swapped = [[places(s) for s in swaps(w, groups)] for w in words]
        yield arrow.batch(schema, [rows.column(1), own, swapped])


class Sparse:
    """Rows of few (place, value) pairs, for products with a vector from either side."""

    def __init__(self, rows: list[dict[int, float]], size: int):
        self.count, self.size = len(rows), size
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.place = np.array([p for r in rows for p in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], self.count)

    def turned(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * y[self.row], self.size)


def changes(own: list[list[int]], swapped: list[list[list[int]]]) -> list[dict[int, float]]:
    """What swaps change, each kind of change once: 1 for a feature that goes, -1 for one that comes."""
    kinds = set()
    for before, others in zip(own, swapped, strict=True):
        have = set(before)
        for after in others:
            new = set(after)
            kinds.add((tuple(sorted(have - new)), tuple(sorted(new - have))))
    return [dict.fromkeys(gone, 1.0) | dict.fromkeys(come, -1.0) for gone, come in sorted(kinds) if gone or come]


def fit_weights(own: list[list[int]], swapped: list[list[list[int]]], label: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss with balanced labels, plus the squared change of the margin for each swap."""
    x = Sparse([dict.fromkeys(r, 1.0) for r in own], size)
    changed = Sparse(changes(own, swapped), size)
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    w = np.zeros(size + 1)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30)))
        miss = weight * (p - label)
        slope = np.append(x.turned(miss) + L2 * w[:-1], miss.sum())
        if changed.count:
            slope[:-1] += 2 * SWAP_WEIGHT * changed.turned(changed.times(w[:-1])) / changed.count
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, groups=IDENTITY_GROUPS) -> tuple[dict[str, float], float]:
    """Weights by feature and bias, from at most ``MOST_LABELLED`` rows of labels(doc_id, toxic).

    Rows without id or label take no part. Without labels of both kinds there are no weights.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    known = known.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # the chosen rows are few by their bound
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), "toxicity-sample")
    names = telling_features(sample)
    if not names:
        return {}, 0.0
    names += sorted({t for g in groups for t in features_of(set(g))} - set(names))
    places = sample.mapInArrow(
        lambda it: place_batches(it, names, groups), "label int, own array<int>, swapped array<array<int>>"
    )
    rows = places.toArrow()
    label = rows.column("label").to_numpy().astype(float)
    weights, bias = fit_weights(rows.column("own").to_pylist(), rows.column("swapped").to_pylist(), label, len(names))
    return {n: float(v) for n, v in zip(names, weights, strict=True) if v}, bias


@functools.lru_cache(maxsize=2)
def scorer(weights: tuple[tuple[str, float], ...], bias: float):
    table = dict(weights)

    def score(text: str | None) -> float:
        found = features_of(words_of(text or "")) & table.keys()
        # summed in a fixed order, so equal texts have equal scores
        margin = bias + sum(table[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30)))) if table else 0.0

    return score


def score_batches(batches: Iterator[pa.RecordBatch], weights: tuple[tuple[str, float], ...], bias: float):
    score = scorer(weights, bias)
    for rows in batches:
        yield arrow.batch(SCORED, [rows.column(0), [score(t) for t in rows.column(1).to_pylist()]])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", groups=IDENTITY_GROUPS) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, score, predicted``, learnt from labels(doc_id, toxic).

    One row comes out per row that goes in; other columns are not read. Missing and empty texts have the
    score of a text without any telling word; without labels of both kinds every score is 0. Missing keys stay missing,
    repeated rows get equal scores, long texts are searched in parts, an empty table gives an empty one.
    """
    arrow.prepared(docs.sparkSession)
    weights, bias = fit(docs, labels, key, text, groups)
    fixed = tuple(sorted(weights.items()))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    scored = rows.mapInArrow(lambda it: score_batches(it, fixed, bias), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

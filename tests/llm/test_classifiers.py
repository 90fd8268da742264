"""Quality, language and toxicity: brute force for the counts, held-out accuracy for what is learnt."""

import random
import re
from collections import Counter

import numpy as np
import regex
import zstandard
from pyspark.sql import functions as F

from tablesieve.llm import language, quality, toxicity, trees

SF = "/root/testdata/sf0.01"
CLASH = ", score string, label string, features string, kept string, h string, bucket string"


def docs(spark, rows, extra=CLASH):
    names = extra.count(" string") and re.findall(r"(\w+) string", extra)
    return spark.createDataFrame([(*r, *["-"] * len(names)) for r in rows], "doc_id long, text string, lang string" + extra)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked)


def test_counts():
    draw = random.Random(2)
    texts = ["", " \n", "a", "a b c", "a b c a b c", "é\x1cü\xa0x #|<\n\n#|<\n x \n x ", "a a a a"]
    texts += ["".join(draw.choice("ab c\n\t#é") for _ in range(draw.randint(0, 80))) for _ in range(300)]
    for text in texts:
        assert quality.counts(text.encode())[:5] == plain_counts(text), text


def test_many_distinct_words(monkeypatch):
    words = [str(i).encode() for i in range(200)] * 2
    assert quality.repeated_words(words) == 400


def test_base_rules_and_odd_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (2, "word " * 49, "en"), (3, "a b c " * 100, "en"), (3, "a b c " * 100, "en")]
    rows += [(4, " ".join(f"w{i}" for i in range(60)), "en"), (5, " ".join(f"w{i}" for i in range(300_000)), "en")]
    labels = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int")
    found = quality.judge(docs(spark, rows), labels).collect()
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    assert [r.base_failed for r in found] == [True] * 5 + [False] * 2
    assert [r.kept for r in found] == [not r.base_failed for r in found]
    kept = quality.keep_good(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and [r.doc_id for r in kept.collect()] == [4, 5]
    assert quality.judge(docs(spark, []), labels).count() == 0


def test_quality_held_out(spark):
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    known = labels.where(F.col("doc_id") % 3 != 0)
    rows = quality.judge(table, known).join(labels.where(F.col("doc_id") % 3 == 0), "doc_id").where("not base_failed").collect()
    wrong = [r for r in rows if r.kept != (r.quality == 1)]
    assert len(rows) > 80 and len(wrong) <= 0.03 * len(rows)


def test_trees_respect_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(600) > 0.6).astype(float)
    forest = trees.fit(x, y, [1, -1, 0])
    assert np.mean((forest.score(x) > 0.5) == y) > 0.85
    for feature, way in ((0, 1), (1, -1)):
        line = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
        line[:, :, feature] = np.linspace(0, 1, 40)
        steps = np.diff(forest.margin(line.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (way * steps >= -1e-12).all()


def test_trees_are_the_sum_of_their_leaves():
    rng = np.random.default_rng(1)
    x = rng.random((200, 2))
    forest = trees.fit(x, (x[:, 0] > 0.5).astype(float), [0, 0])

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + (row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert trees.fit(x, np.ones(200), [0, 0]).score(x).min() > 0.5
    assert trees.fit(np.zeros((0, 2)), np.zeros(0), [0, 0]).score(x).min() > 0.5


def test_language_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.remainder(F.col("doc_id"), 4) == 2
    found = language.identify(table, table.where(~held).select("lang", "text"))
    rows = found.join(table.where(held).select("doc_id", "lang", "n_chars"), "doc_id").collect()
    long = [r for r in rows if r.n_chars >= 300]
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert np.mean([r.lang_pred == r.lang for r in long]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in long]) < 0.02


def test_language_one_text_at_a_time(spark):
    """The same dictionaries and plain zstandard, one text after the other."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    known = table.where(F.col("doc_id") % 4 != 0).select("lang", "text")
    contents = language.dictionaries(language.training_texts(known))
    assert len(contents) == 4
    packers = {}
    for name, content in contents.items():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[name] = zstandard.ZstdCompressor(level=7, dict_data=held, write_content_size=False, write_dict_id=False)
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in language.identify(table, known).collect():
        data = texts[r.doc_id].lower().encode()
        sizes = {n: sum(len(p.compress(data[i : i + 2048])) for i in range(0, max(1, len(data)), 2048)) for n, p in packers.items()}
        best = min(sizes, key=sizes.get) if re.search(r"[^\W\d_]", texts[r.doc_id]) else "und"
        assert r.lang_pred == best, r.doc_id


def test_training_takes_parts_from_all_of_a_text(spark):
    long = "".join(f"{i:06d} word " for i in range(20_000))
    found = language.training_texts(spark.createDataFrame([("en", long), ("en", "short text"), ("de", long[:1200])], "lang string, text string"))
    parts = max(found["en"], key=len).split("\n")
    assert len(parts) == 6 and parts[0] == long[:200] and parts[-1] == long[-200:] and all(p in long for p in parts)
    assert "short text" in found["en"] and found["de"] == [long[:1200]]


def test_language_odd_rows(spark):
    known = spark.createDataFrame(
        [("en", "the cat and the dog sat on the mat " * 9)] * 50 + [("de", "der hund und die katze saßen auf dem dach " * 9)] * 3
        + [(None, "x y z"), ("fr", None), ("es", "123")], "lang string, text string"
    )
    rows = [(None, None, None), (1, "", None), (2, "123 -- !!", None), (3, "the dog on the mat", None), (3, "the dog on the mat", "de"),
            (4, "Der Hund und die Katze " * 20_000, None)]
    found = language.identify(docs(spark, rows), known).collect()
    assert [r.lang_pred for r in found] == ["und", "und", "und", "en", "en", "de"]
    assert [r.rejected for r in found][:3] == [True] * 3 and not found[3].rejected
    assert found[3][1:] == found[4][1:]
    kept = language.keep_identified(docs(spark, rows), known)
    assert [r.doc_id for r in kept.collect()] == [3, 3, 4] and kept.columns == docs(spark, rows).columns
    assert {r.lang_pred for r in language.identify(docs(spark, rows), known.limit(0)).collect()} == {"und"}
    assert language.identify(docs(spark, []), known).count() == 0


def test_toxicity_held_out(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = language.remainder(F.col("doc_id"), 5) == 0
    rows = toxicity.score(table, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.02


def test_toxicity_one_text_at_a_time(spark):
    """Weights applied to the words of one text after the other, without the operator's functions."""
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    weights, bias = toxicity.fit(table, labels, "doc_id", "text")
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in toxicity.score(table, labels).collect():
        words = set(regex.findall(r"[\p{L}\p{M}\p{N}]+", texts[r.doc_id].lower()))
        found = words | {"*" + w[:5] for w in words if len(w) > 5}
        want = 1 / (1 + np.exp(-np.clip(bias + sum(weights.get(f, 0.0) for f in found), -30, 30)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_weights_are_those_of_dense_matrices():
    rng = np.random.default_rng(8)
    own = [sorted(rng.choice(30, rng.integers(0, 8), replace=False).tolist()) for _ in range(60)]
    swapped = [[sorted({*row[1:], int(rng.integers(30))})] if row and i % 2 else [] for i, row in enumerate(own)]
    x = np.zeros((60, 30))
    for i, row in enumerate(own):
        x[i, row] = 1
    sparse = toxicity.Sparse([dict.fromkeys(r, 1.0) for r in own], 30)
    w, y = rng.normal(size=30), rng.normal(size=60)
    assert np.allclose(sparse.times(w), x @ w) and np.allclose(sparse.turned(y), x.T @ y)
    dense = {tuple(x[i] - np.isin(np.arange(30), s)) for i, row in enumerate(swapped) for s in row}
    found = toxicity.changes(own, swapped)
    rows = {tuple(np.array([r.get(j, 0.0) for j in range(30)])) for r in found}
    assert rows == {d for d in dense if any(d)} and len(found) == len(rows)


def biased(spark):
    """Toxic texts that mostly name one group, clean ones that hardly do."""
    draw = random.Random(6)
    filler = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        words = draw.sample(filler, 12)
        toxic = i % 2
        if toxic:
            words += ["vile", "scum"][: draw.randint(1, 2)]
        if draw.random() < (0.8 if toxic else 0.05):
            words.append("muslims")
        rows.append((i, " ".join(words), None))
        labels.append((i, toxic))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neutral_mentions_are_not_toxic(spark, monkeypatch):
    table, labels = biased(spark)
    probes = docs(spark, [(1, "word1 word2 word3 muslims", None), (2, "word1 word2 word3 people", None), (3, "word4 vile scum", None)])
    fair = {r.doc_id: r.score for r in asked(table, labels, probes)}
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    unfair = {r.doc_id: r.score for r in asked(table, labels, probes)}
    assert unfair[1] - unfair[2] > 3 * abs(fair[1] - fair[2])
    assert fair[1] < 0.5 < fair[3]


def asked(table, labels, probes):
    weights, bias = toxicity.fit(table, labels, "doc_id", "text")
    score = toxicity.scorer(tuple(sorted(weights.items())), bias)
    return [type("Row", (), {"doc_id": r.doc_id, "score": score(r.text)}) for r in probes.collect()]


def test_swaps():
    groups = (("people", "women", "men"),)
    found = list(toxicity.swaps({"some", "women"}, groups))
    assert sorted(sorted(f) for f in found) == [["*peopl", "people", "some"], ["men", "some"]]


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = [(i, "vile thing here" if i % 2 else "nice thing here", None) for i in range(40)]
    rows += [(None, None, None), (50, "", None), (51, "vile " * 100_000, None), (51, "vile " * 100_000, None)]
    found = toxicity.score(docs(spark, rows), labels).collect()
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    assert [r.predicted for r in found[:40]] == [i % 2 for i in range(40)]
    assert found[-1].predicted == 1 and found[-1].score == found[-2].score
    assert all(0 <= r.score <= 1 for r in found)
    none = toxicity.score(docs(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(docs(spark, []), labels).count() == 0

"""Near-duplicate classes and nearest neighbours against brute force; components on hard shapes."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesieve.llm import jaccard, neighbours
from tablesieve.llm.components import components
from tablesieve.runtime import materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, set_id string, token string, n string, _row string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", "3", "4", "5") for r in rows], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for t in s:
            for j in holders[t]:
                common[j] += 1
            holders[t].append(i)
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    first = {r: min((k for k in keys if k is not None), default=None) for r, keys in least.items()}
    return [(key, len(s), first[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    """Random texts, near copies at many distances, chains, short texts, and a passage that many share."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = draw.choices(words, k=draw.choice([3, 5, 6, 30, 120, 400]))
        texts.append(base)
        for _ in range(draw.choice([0, 1, 3, 12])):
            copy = list(draw.choice(texts[-3:]))
            for _ in range(draw.randint(0, max(1, len(copy) // 30))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(copy)
    for _ in range(80):
        texts.append(passage + draw.choices(words, k=draw.choice([0, 5, 10, 14, 16, 20, 200])))
    for n in range(40):
        texts.append(passage[: 20 + n])
    out = [draw.choice([" ", "\n"]).join(t) if draw.random() < 0.9 else " ".join(t).upper() for t in texts]
    return list(enumerate(draw.sample(out, len(out)), start=100))


@pytest.mark.parametrize("seed", range(3))
def test_classes_are_exact(spark, seed, monkeypatch):
    # each text in the sample, so that the order of tokens differs from that of their hashes
    monkeypatch.setattr(jaccard, "SAMPLE_STEP", 1 + seed)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(seed)
    found = jaccard.near_duplicates(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(classes(rows))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One Two"), (9, "one two"), (9, "one two"), (10, "one  two three"), (None, "one two"),
            (None, "alone here"), (11, long), (12, long + " end"), (3, "é É a b c d"), (4, "é É A b c d")]
    found = sorted(map(tuple, jaccard.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert found == sorted(classes(rows), key=str)
    kept = jaccard.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {r.n for r in kept.collect()} == {"4"}
    # documents without shingles all stay, as does the one without key that has a class of its own
    stays = [r for r in rows if r[0] in {5, 6, 7, 8, 10, 11, 3}] + [(None, "alone here")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(stays, key=str)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    draw = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for key in range(600):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(300)] = f"x{draw.random()}"
        rows.append((key, " ".join(copy)))
    found = jaccard.near_duplicates(docs(spark, rows)).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [0]


def boilerplate(n):
    """Pages that share most of their words and no link: 85 of 127 shingles."""
    shared = " ".join(f"s{i}" for i in range(89))
    return [(k, shared + " " + " ".join(f"own{k}x{i}" for i in range(17))) for k in range(n)]


def test_shared_passages_make_no_pairs(spark):
    met = {}
    for n in (400, 1600):
        texts = jaccard.identified(docs(spark, boilerplate(n)), "doc_id", "text")
        frequent = spark.sparkContext.broadcast(jaccard.frequent_tokens(texts.select("text")))
        sets = materialize(texts.mapInArrow(lambda it, frequent=frequent: jaccard.set_batches(it, frequent), jaccard.SETS), "sets")
        keys = jaccard.keyed(sets)
        groups = jaccard.group_members(sets, spark.createDataFrame([], "node long, root long"), keys)
        met[n] = jaccard.met_groups(sets, groups).count()
    assert met[1600] <= 4 * max(met[400], 100), met


def test_groups_are_met_by_several_tokens(spark):
    """Texts of 200 words that share a few rare shingles, no more than any link needs, do not meet."""
    texts = [" ".join(f"s{k // 2}x{i}" if i < 7 else f"own{k}x{i}" for i in range(200)) for k in range(400)]
    rows = jaccard.identified(docs(spark, list(enumerate(texts))), "doc_id", "text")
    frequent = spark.sparkContext.broadcast((np.array([], np.uint64), np.array([], np.int64)))
    sets = materialize(rows.mapInArrow(lambda it: jaccard.set_batches(it, frequent), jaccard.SETS), "sets")
    groups = jaccard.group_members(sets, spark.createDataFrame([], "node long, root long"), jaccard.keyed(sets))
    assert jaccard.met_groups(sets, groups).count() == 0


def test_a_group_is_looked_up_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    base[1] = base[0] + np.uint64(1 << 32)  # equal in a sketch
    held = [(k, jaccard.sketch(np.concatenate([base[: 300 - 20 * k], rng.integers(0, 1 << 63, 20 * k, dtype=np.uint64)]))) for k in range(6)]
    query = np.concatenate([base[:290], rng.integers(0, 1 << 63, 8, dtype=np.uint64)])
    for limit in (jaccard.HELD_TOKENS, 0):
        monkeypatch.setattr(jaccard, "HELD_TOKENS", limit)
        members = jaccard.Members(held)
        assert members.common(jaccard.counted_once(jaccard.sketch(query))).tolist() == [290, 280, 260, 240, 220, 200]
        assert members.qualified(9, jaccard.sketch(query), False) == [0, 1]
        assert members.qualified(9, jaccard.sketch(query), True) == [0]
        assert members.qualified(0, jaccard.sketch(query), True) == [1]


def test_queries_and_members_are_rows_by_themselves(spark, monkeypatch):
    """Many queries that come to a large group make a pair where they link, and none elsewhere."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = [(k, jaccard.sketch(np.concatenate([base[:196], rng.integers(0, 1 << 63, 4, dtype=np.uint64)]))) for k in range(100)]
    # enough of the group's tokens for a link to one of these, not for two
    far = [(k, jaccard.sketch(np.concatenate([base[:150], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))) for k in range(100, 400)]
    linked = [(400, jaccard.sketch(base))]
    sketches = spark.createDataFrame([(k, bytearray(s)) for k, s in near + far + linked], "set_id long, sketch binary")
    groups = spark.createDataFrame([(k, -1) for k in range(100)], "set_id long, group long")
    asked = spark.createDataFrame([(-1, k, True) for k in range(100, 401)], "a long, b long, one boolean")
    found = jaccard.opened_groups(asked, groups, sketches).collect()
    assert [r.a for r in found] == [400]
    every = jaccard.opened_groups(asked.withColumn("one", F.lit(False)), groups, sketches).collect()
    assert sorted(r.b for r in every) == list(range(100)) and {r.a for r in every} == {400}


def test_a_large_group_does_not_ask_for_each_set_near_it(spark):
    """Of a large group and a set that stands near it, the set is sent; it is found whether it is the larger one or not."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    near = [" ".join(base[:149] + [f"n{k}"]) for k in range(200)]
    # about half of the shingles in common, which makes no link
    far = [" ".join(base[:75] + [f"f{k}x{i}" for i in range(75)]) for k in range(10)]
    larger, smaller = " ".join(base + [f"l{i}" for i in range(15)]), " ".join(base[:140])
    texts = near + far + [larger, smaller]
    draw.shuffle(texts)
    rows = jaccard.identified(docs(spark, list(enumerate(texts))), "doc_id", "text")
    frequent = spark.sparkContext.broadcast((np.array([], np.uint64), np.array([], np.int64)))
    sets = materialize(rows.mapInArrow(lambda it: jaccard.set_batches(it, frequent), jaccard.SETS), "sets")
    names = {text: jaccard.set_id(jaccard.Shingler().tokens(text.encode())) for text in texts}
    root = min(names[t] for t in near)
    roots = spark.createDataFrame([(names[t], root) for t in near], "node long, root long")
    no_keys = spark.createDataFrame([], "set_id long, band int, key long, block long, blocks long")
    groups = jaccard.group_members(sets, roots, no_keys)
    met = materialize(jaccard.met_groups(sets, groups), "met")
    assert met.count() <= len(far + [larger, smaller]) ** 2
    first_rows = materialize(sets.groupBy("set_id").agg(F.min("row").alias("row")), "set-rows")
    links = jaccard.linked(jaccard.sharing(met, groups, sets), groups, rows.select("row", "text"), first_rows).collect()
    linked = {frozenset((r.a, r.b)) for r in links}
    for text in (larger, smaller):
        assert any(names[text] in pair and pair & {names[t] for t in near} for pair in linked)
    assert not any(names[t] in pair for t in far for pair in linked)


def test_boilerplate_has_no_links(spark):
    found = jaccard.near_duplicates(docs(spark, boilerplate(500))).collect()
    assert all(r.doc_id == r.component_id for r in found) and len(found) == 500


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    links = spark.createDataFrame(chain + star + [(7, 7), (-5, 9)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(500, 560)} == {500}
    assert found[7] == 7 and found[9] == -5
    assert components(links.limit(0)).count() == 0


def brute(rows, k, step):
    found = {}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, q in usable:
        if i % step == 0:
            scores = sorted(((-float((q * v).sum()), j) for j, v in usable if j != i))[:k]
            found[i] = [(j, -s) for s, j in scores]
    return found


VECTORS = "vec_id long, embedding array<float>, cell string, place string, score string"


def search(spark, rows, k, step=5):
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    out = defaultdict(list)
    for r in sorted(neighbours.search(table, F.col("vec_id") % step == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUNDLE_ROWS", 64)
    monkeypatch.setattr(neighbours, "HELD_PAIRS", 500)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16)]) for i in range(1500)]
    found, want = search(spark, rows, 10), brute(rows, 10, 5)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q in want:
        vectors = dict(rows)
        for i, s in found[q]:
            assert s == float((np.array(vectors[q]) * np.array(vectors[i])).sum())


def test_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUNDLE_ROWS", 16)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(60 + i, [0.0, 1.0, float(i)]) for i in range(6)]
    rows += [(70, None), (75, []), (80, [0.0, 0.0, 0.0]), (85, [1.0, None, 0.0]), (90, [1.0, float("nan"), 0.0]),
             (95, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 1.0])]
    found, want = search(spark, rows, 7), brute([r for r in rows if r[0] != 100], 7, 5)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_recall_on_the_given_vectors(spark):
    """At the settings of the query, on the given table."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    found, want = search(spark, rows, 20, 20), brute(rows, 20, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(found) == set(want) and hits >= 0.9 * 20 * len(want)


def test_the_test_ends_searches_early(spark):
    """Clusters far apart: a query verifies a small share of the rows, in steps, and finds its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 16)) * 20
    rows = [(i, [float(x) for x in centres[i % 100] + rng.normal(size=16) * 0.1]) for i in range(4000)]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    found, steps = neighbours.search_steps(table, F.col("vec_id") % 40 == 0, 10)
    verified = sum(s.agg(F.sum("rows")).first()[0] for s in steps)
    assert len(steps) > 1 and verified < 0.5 * 100 * 4000
    want = brute(rows, 10, 40)
    hits = sum(1 for r in found.collect() if r.vec_id in {i for i, _ in want[r.query_id]})
    assert hits >= 0.9 * 10 * len(want)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0, float(i)]) for i in range(10)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(4)] + [(20, [1.0])]
    found = search(spark, rows, 20, 5)
    assert set(found) == {0, 5} and {i for i, _ in found[5]} == set(range(10)) - {5}


def test_few_and_repeated(spark):
    assert not search(spark, [], 3)
    assert not search(spark, [(0, [1.0, 2.0])], 3)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0])]
    assert dict(search(spark, rows, 3)) == {0: [(1, 5.0)]}


def test_chi_square_quantile():
    # values of the distribution's published table
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.9, 2) == pytest.approx(4.605, abs=1e-3)

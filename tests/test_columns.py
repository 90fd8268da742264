"""Clustering, choice and column selection on small literal cases."""

import math
import random

import pytest

from tablesieve.operators import choose, clusters as cl, columns as co, votes as vo

SCORES = "qid long, col_ord int, col_name string, llm double, sim double"


def scores(spark, *groups):
    rows = [(q, i, f"c_{i}", x, y) for q, points in enumerate(groups) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, SCORES)


def labels(frame):
    out = {}
    for r in frame.orderBy("qid", "col_ord").collect():
        out.setdefault(r.qid, []).append(r.cluster_id)
    return out


def test_fewer_distinct_points_than_clusters(spark):
    got = labels(cl.cluster_columns(scores(
        spark, [(0.5, 0.5)] * 5, [(0.1, 0.1), (0.9, 0.9)], [(0.2, 0.2), (0.2, 0.2), (0.8, 0.8)],
        [(0.0, 0.0), (0.05, 0.0), (0.5, 0.5), (0.52, 0.5), (1.0, 1.0)],
    )))
    assert got == {0: [0] * 5, 1: [0, 1], 2: [0, 0, 1], 3: [0, 0, 1, 1, 2]}


def lloyd(points):
    """Rounds from the first, middle and last distinct point by sum until nothing moves; and how many it took."""
    steady = lambda v, d: math.floor(v * 10.0**d + 0.5) / 10.0**d
    distinct = sorted({(round(x + y, 12), round(x, 12), round(y, 12)) for x, y in points})
    m = len(distinct)
    centres = [distinct[i - 1][1:] for i in dict.fromkeys([1, math.ceil(m / 2), m])]
    rounds = 0
    while True:
        near = [min(range(len(centres)), key=lambda k: (steady((centres[k][0] - x) ** 2 + (centres[k][1] - y) ** 2, 9), k)) for x, y in points]
        after = []
        for k, old in enumerate(centres):
            own = [p for p, n in zip(points, near) if n == k]
            after.append(tuple(steady(sum(p[j] for p in own) / len(own), 12) for j in (0, 1)) if own else old)
        if after == centres:
            return near, rounds
        centres, rounds = after, rounds + 1


def test_rounds_go_on_until_nothing_moves(spark):
    draw = random.Random(3)
    groups = [[(draw.random(), draw.random()) for _ in range(n)] for n in [100] * 30 + [300] * 10]
    got = labels(cl.cluster_columns(scores(spark, *groups)))
    want = [lloyd(g) for g in groups]
    assert sum(rounds > 10 for _, rounds in want) > 5 and max(rounds for _, rounds in want) > cl.RUN
    assert [got[q] for q in range(len(groups))] == [near for near, _ in want]


def test_three_way_split_goes_to_the_best_own_score(spark):
    """Where each method prefers another cluster, the one with the best score of its own method wins."""
    draw = random.Random(5)
    rows = []
    for q in range(300):
        for i in range(9):
            rows.append((q, i % 3, i, draw.choice(["x", f"a{i}_b{i}"]), draw.random(), draw.random()))
    mean = {}
    for q, k, _, _, x, y in rows:
        mean.setdefault((q, k), []).append((x, y))
    mean = {key: [sum(v) / len(v) for v in zip(*points)] for key, points in mean.items()}
    frame = spark.createDataFrame([(*r, *mean[r[:2]]) for r in rows],
                                  "qid long, cluster_id int, col_ord int, col_name string, llm double, sim double, cx double, cy double")
    questions = spark.createDataFrame([(q, "show all") for q in range(300)], "qid long, question string")
    split = 0
    for row in choose.choose_cluster(frame, questions).collect():
        choices = [row.semantic_choice, row.mcdm_choice, row.adaptive_choice]
        assert sum(row.votes.values()) == 3 and set(row.votes) == {0, 1, 2}
        if len(set(choices)) == 3:
            split += 1
            scored = dict(zip(choices, [row.semantic_score, row.mcdm_score, row.adaptive_score]))
            assert row.selected == max(scored, key=scored.get)
        else:
            assert choices.count(row.selected) >= 2
    assert split >= 3


def test_ties_between_clusters(spark):
    """Equal clusters: the semantic choice takes the lowest id, the others the earliest column."""
    rows = [(0, 1, 0, "a", 0.5, 0.5, 0.5, 0.5), (0, 0, 1, "b", 0.5, 0.5, 0.5, 0.5)]
    frame = spark.createDataFrame(rows, "qid long, cluster_id int, col_ord int, col_name string, llm double, sim double, cx double, cy double")
    questions = spark.createDataFrame([(0, "anything")], "qid long, question string")
    row = choose.choose_cluster(frame, questions).collect()[0]
    assert (row.semantic_choice, row.mcdm_choice, row.adaptive_choice, row.selected) == (0, 1, 1, 1)


def test_selected_columns_in_order(spark):
    rows = [(0, 0, 0, "a"), (0, 1, 1, "b"), (0, 1, 2, "c"), (0, 2, 3, "d"), (0, 2, 4, "e"), (0, 1, 5, "Row Header")]
    value = {"a": 0.9, "b": 0.2, "c": 0.3, "d": 0.6, "e": 0.6, "Row Header": 0.0}
    frame = spark.createDataFrame([(*r, value[r[3]], value[r[3]]) for r in rows],
                                  "qid long, cluster_id int, col_ord int, col_name string, llm double, sim double")
    choice = spark.createDataFrame([(0, 0)], "qid long, selected int")
    essential = spark.createDataFrame([(0, 0, "e"), (0, 1, "a")], "qid long, ess_ord int, col_name string")
    got = [r.col_name for r in co.select_columns(frame, choice, essential).orderBy("pos").collect()]
    assert got == ["a", "c", "d", "e", "Row Header"]


def test_top_columns_of_narrow_and_wide_tables(spark):
    narrow, wide = [(i / 10, 0.0) for i in range(5)], [(i / 10, 0.0) for i in range(10)]
    frame = co.top_norm_columns(scores(spark, narrow, wide)).orderBy("qid", "pos").collect()
    assert [r.col_ord for r in frame if r.qid == 0] == [4, 3, 2]
    assert [r.col_ord for r in frame if r.qid == 1] == [6, 7, 8, 9]


def test_votes(spark):
    columns = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "qid long, col_ord int, col_name string")
    votes = spark.createDataFrame([(0, 0, "a", 0.8), (0, 2, "a", 0.4), (0, 2, "b", 0.4), (0, 2, "zzz", 1.0)],
                                  "qid long, iteration int, col_name string, score double")
    filled = vo.fill_votes(columns, votes)
    got = {r.col_name: r for r in vo.reliable_scores(filled).collect()}
    assert got["a"]["mean"] == pytest.approx(0.6) and got["a"]["std"] == pytest.approx(0.2)
    assert got["b"]["adjusted"] == pytest.approx(0.2 / 1.2)
    ranks = {r.col_name: r.median_rank for r in vo.median_rank(filled).collect()}
    assert ranks == {"a": pytest.approx(0.75), "b": pytest.approx(0.75)}


def test_flat_scores_keep_their_value(spark):
    frame = spark.createDataFrame([(0, 0.3), (0, 0.3), (1, 0.1), (1, 0.5)], "qid long, x double")
    assert sorted(r.x for r in vo.min_max(frame, "x").collect()) == [0.0, 0.3, 0.3, 1.0]

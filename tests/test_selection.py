"""The first rows of groups without a full sort, and sums of softmax from one pass."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablesieve.operators import rows as rw, selection as se
from tablesieve.runtime import materialize

KEYS = ["a", "b", "row_id"]


def frame(spark, rows, row_id="long"):
    return spark.createDataFrame(rows, f"g string, a double, b double, row_id {row_id}")


def share(size):
    return F.greatest(F.lit(1), F.ceil(size * 0.4))


def expected(rows):
    out = set()
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:], reverse=True)
        out |= {(*r, i) for i, r in enumerate(ordered[: max(1, math.ceil(len(ordered) * 0.4))])}
    return out


def found(frame):
    return {(r.g, r.a, r.b, r.row_id, r.place) for r in se.select_best(materialize(frame), "g", KEYS, share).collect()}


CASES = {
    "spread": [("x", i * 37 % 1000 / 7, 0.0, i) for i in range(1000)],
    "one value": [("x", 0.5, 0.0, i) for i in range(700)],
    "two values": [("x", float(i % 2), float(i % 3), i) for i in range(900)],
    "very different sizes": [("x", 10.0 ** -(i % 290), 0.0, i) for i in range(600)],
    "negative": [("x", -float(i % 100) ** 3, float(-i % 7), -i) for i in range(600)],
    "far ids": [("x", 0.0, 0.0, (-1) ** i * (2**63 - 1 - i)) for i in range(300)],
    "groups": [(f"g{i % 50 if i % 3 else 0}", 1 / (1 + i % 11), float(i % 5), i) for i in range(2000)],
    "single": [("x", 1.0, 1.0, 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_first_rows(spark, name):
    assert found(frame(spark, CASES[name])) == expected(CASES[name])


def test_text_ids(spark):
    rows = [("x", float(i % 2), 0.0, f"r{i:03}") for i in range(400)]
    assert found(frame(spark, rows, "string")) == expected(rows)


def test_no_more_than_the_last_range_is_sorted(spark):
    rows = materialize(frame(spark, [("x", math.sin(i), 0.0, i) for i in range(20_000)]))
    (end,) = se.ranges(rows, "g", KEYS, share).collect()
    assert end.wanted == 8000 and 0 < end.need <= end.size <= 400
    above = rows.where(F.struct(*KEYS) > F.struct(*[F.lit(end.high[k]).alias(k) for k in KEYS])).count()
    assert above == end.wanted - end.need


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from([0.0, 1e-9, 0.5, 0.75, 3.0]), st.integers(0, 2).map(float)), max_size=120))
def test_any_ties(spark, drawn):
    rows = [(*r, i) for i, r in enumerate(drawn)]
    assert found(frame(spark, rows)) == expected(rows)


def test_softmax_of_far_scores(spark):
    scores = {1: [700.0, -700.0, 699.5, 0.0], 2: [-700.0, -700.0], 3: [1e4, -1e4, 1e4 - 1], 4: [0.0]}
    rows = [(q, float(i), s, -s) for q, listed in scores.items() for i, s in enumerate(listed)]
    frame = materialize(spark.createDataFrame(rows, "qid long, row_id double, s double, t double").repartition(5))
    for r in rw.softmax(frame, ["s", "t"]).collect():
        for value, part, sign in ((r.s, r.s_p, 1), (r.t, r.t_p, -1)):
            listed = [sign * x for x in scores[r.qid]]
            assert part == pytest.approx(math.exp(value - max(listed)) / sum(math.exp(x - max(listed)) for x in listed), rel=1e-12)


def test_softmax_totals_are_one_pass(spark):
    frame = materialize(spark.createDataFrame([(1, 1.0)], "qid long, s double"))
    plan = rw.softmax_totals(frame, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_selection_equals_full_ranking(spark):
    rows = spark.createDataFrame([("t", i, f"apple {'pie ' * (i % 5)} {'red' if i % 3 else 'green'} t{i % 40}") for i in range(300)],
                                 "corpus string, row_id long, text string")
    questions = spark.createDataFrame([(1, "t", "red pie t7"), (2, "t", "unknown")], "qid long, corpus string, question string")
    full = rw.keep_top(rw.rank_table_rows(questions, rows)).select("qid", "row_id", "rnk").collect()
    best = rw.top_table_rows(questions, rows).select("qid", "row_id", "rnk").collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, best)) and len(best) == 240

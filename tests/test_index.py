"""The stored index gives the scores of a fresh build, whatever was added when; point sets agree with the array form."""

import re

import pytest
from pyspark.sql import functions as F

from tablesieve.operators import clusters as cl, index as ix, pages as pg, point_sets as ps, rows as rw
from tablesieve.runtime import materialize, scratch_path


def texts(spark, start, stop):
    rows = [(("a", "b", "hot")[min(i % 7, 2)], i, f"word{i % 13} common {'apple ' * (i % 4)}x{i}") for i in range(start, stop)]
    return spark.createDataFrame([*rows, ("a", 10_000 + start, None), ("empty", 20_000 + start, "")], "corpus string, row_id long, text string")


def questions(spark):
    listed = [(1, "a", "common word3 apple"), (2, "hot", "x20 word5 word5"), (3, "hot", "nothing known"), (4, "empty", "apple"), (5, "b", "")]
    return spark.createDataFrame(listed, "qid long, corpus string, question string")


def scored(frame):
    return {(r.qid, r.corpus, r.row_id): (round(r.tfidf, 9), round(r.bm25, 9), r.n) for r in frame.collect()}


@pytest.fixture(scope="module")
def index(spark):
    index = ix.Index(spark, scratch_path(spark, "index-test"))
    assert ix.add_rows(index, texts(spark, 0, 100)) == 102
    return index


def test_additions_and_repeats(spark, index):
    fresh = scored(rw.score_rows(questions(spark), texts(spark, 0, 100)))
    assert scored(ix.score_index(index, questions(spark))) == fresh
    more = texts(spark, 100, 160)
    assert ix.add_rows(index, more) == 62
    assert ix.add_rows(index, more) == 0, "rows that are there are not added again"
    whole = texts(spark, 0, 100).unionByName(more)
    fresh = scored(rw.score_rows(questions(spark), whole))
    assert scored(ix.score_index(index, questions(spark), block_rows=7)) == fresh
    small = ix.compact(index, scratch_path(spark, "index-small"), blocks=4)
    assert scored(ix.score_index(small, questions(spark))) == fresh


def test_an_unlisted_addition_does_not_count(spark, index):
    before = index.rows().count()
    broken = f"{index.path}/rows/segment=broken"
    spark.createDataFrame([("a", 77_777, 3)], "corpus string, row_id long, len long").write.parquet(broken)
    assert index.rows().count() == before


def test_only_asked_blocks_are_read_and_no_text(spark, index):
    asked = rw.question_terms(ix.statistics(index), questions(spark).where("qid = 1"), (rw.WORD, rw.PIECE))
    found = ix.asked_postings(index, asked)
    name = "spark.sql.maxMetadataStringLength"
    saved = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, saved)
    listed = re.search(r"PartitionFilters: \[.*?\bblock#\d+ (?:IN|INSET) \(?([\d, ]+)", plan)
    assert listed, plan
    assert 0 < len(listed[1].split(",")) < ix.BLOCKS / 4
    assert "text" not in index.postings().columns + index.rows().columns + index.terms().columns


def test_stored_postings_are_those_of_the_texts(spark, monkeypatch):
    """Odd white space, letters of many scripts, missing values, ids that repeat: counted in Python as by expressions, however they are cut."""
    odd = [
        "Été\u00a0ĀÀ ß STRASSE İstanbul ǅ", "x\x1cy\x85zz\u2003ab\u3000cd\u200bef", "Привет мир_42 ² ⅷⅷ ٣٤ 日本語 한국", "a bb ccc a a-b a--b", "",
        None, "   ", "\U0001f600\U0001f600 \U00010400\U00010428 e\u0301e", "tab\tline\nfeed\x0bvt\x0cff\rcr", "ſ K Å straße",
    ]
    rows = [(("a", "b", None)[i % 3], i // 2 if i % 5 else None, odd[i % len(odd)]) for i in range(60)]
    rows += [("a", 1000, "same text"), ("a", 1000, "same text"), ("a", 1000, "other text"), ("a", 1000, "a longer one"), ("c", None, "no id"), ("c", None, "no id")]
    frame = materialize(spark.createDataFrame(rows, "corpus string, row_id long, text string"))
    columns = ["corpus", "row_id", "kind", "term", "tf", "len"]
    counted = materialize(rw.postings(frame))
    want = sorted(map(repr, counted.where(F.col("kind") != rw.MARK).select(columns).collect()))
    marks = sorted(map(repr, counted.where(F.col("kind") == rw.MARK).select("corpus", "row_id", "len").collect()))
    for size in (8_000_000, 1):
        monkeypatch.setattr(pg.functions, "__defaults__", (size,))
        index = ix.Index(spark, scratch_path(spark, "index-odd"))
        assert ix.add_rows(index, frame) == len(marks)
        assert sorted(map(repr, index.postings().select(columns).collect())) == want
        assert sorted(map(repr, index.rows().select("corpus", "row_id", "len").collect())) == marks
    small = ix.compact(index, scratch_path(spark, "index-odd-small"), blocks=4)
    assert sorted(map(repr, small.postings().select(columns).collect())) == want


def test_other_ids_and_corpora_that_are_joined(spark, monkeypatch):
    """Ids of another type, and more corpora than are named in a filter."""
    monkeypatch.setattr(ix, "NAMED_CORPORA", 1)
    rows, index = texts(spark, 0, 60).withColumn("row_id", F.concat(F.lit("r"), "row_id")), ix.Index(spark, scratch_path(spark, "index-text"), "string")
    ix.add_rows(index, rows)
    assert scored(ix.score_index(index, questions(spark))) == scored(rw.score_rows(questions(spark), rows))


def test_an_index_has_a_line_per_page_not_per_posting(spark):
    """What is shuffled, sorted and written does not grow with the vocabulary: a line of it holds the lists of many terms."""
    words = F.concat_ws(" ", *[F.concat(F.lit(f"term{i}x"), F.col("id")) for i in range(200)])
    index = ix.Index(spark, scratch_path(spark, "index-pages"))
    ix.add_rows(index, spark.range(300).select(F.lit("a").alias("corpus"), F.col("id").alias("row_id"), words.alias("text")))
    stored = spark.read.parquet(f"{index.path}/postings").count()
    assert index.terms().count() == index.postings().count() == 2 * 300 * 200
    assert stored < 3 * ix.BLOCKS * 10


def points(spark, sizes):
    rows = [(q, i, f"c{i}", (i * 7919 % 1009) / 1009, (i * i * 31 % 997) / 997) for q, n in sizes.items() for i in range(n)]
    return materialize(spark.createDataFrame(rows, "qid long, col_ord long, col_name string, llm double, sim double"))


def labels(frame):
    return {(r.qid, r.col_ord): (r.cluster_id, round(r.cx, 9), round(r.cy, 9)) for r in frame.collect()}


def test_rows_and_arrays_give_the_same_clusters(spark):
    scores = points(spark, {1: 1, 2: 2, 3: 3, 4: 40, 5: 500, 6: 2000})
    arrays = labels(cl.cluster_columns(scores))
    assert labels(ps.cluster_points(scores)) == arrays
    assert labels(ps.cluster_any(scores, array_points=100)) == arrays
    assert labels(ps.cluster_any(scores)) == arrays


def test_equal_points_and_no_points(spark):
    same = spark.createDataFrame([(1, i, "c", 0.5, 0.5) for i in range(50)], "qid long, col_ord long, col_name string, llm double, sim double")
    assert {r.cluster_id for r in ps.cluster_points(materialize(same)).collect()} == {0}
    assert ps.cluster_points(materialize(same.where(F.lit(False)))).collect() == []


def test_nearest_centre_by_columns_is_that_of_the_array(spark):
    """Ties, fewer centres than three, missing and odd coordinates; no function runs over an array for each point."""
    odd = float("nan")
    centres = spark.createDataFrame(
        [(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (2, [(0.5, 0.5)]), (3, [(0.0, None), (1.0, 1.0)]), (4, [(odd, 0.0), (0.0, 0.0)]), (5, [])],
        "qid long, centres array<struct<x:double,y:double>>",
    )
    values = [(q, x, y) for q in range(1, 6) for x in (0.0, 0.5, 1.5, 2.0, odd, None) for y in (0.0, 0.5, 1.5, None)]
    found = ps.assigned(spark.createDataFrame(values, "qid long, llm double, sim double"), centres)
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    point = F.struct(F.col("llm").alias("x"), F.col("sim").alias("y"))
    assert found.where(~F.col("k").eqNullSafe(cl.nearest(F.col("centres"), point))).count() == 0
    assert found.count() == len(values)

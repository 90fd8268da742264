"""A run folder: every question has one record, runs are taken up again, and what broke off does not count."""

from pyspark.sql import functions as F

from tablesieve.plans import runs
from tablesieve.runtime import materialize, scratch_path

COLUMNS = ["name", "size", "colour", "price"]


def inputs(spark, tables):
    cells = [(t, r, c, n, f"{n} {t} {r}") for t in tables for r in range(5) for c, n in enumerate(COLUMNS)]
    scores = [(q, c, n, (q * 3 + c * 5) % 7 / 7, (q + c * 2) % 5 / 5) for q in (1, 2, 3) for c, n in enumerate(COLUMNS)]
    votes = [(q, i, n, 0.5) for q in (1, 2, 3) for i in range(2) for n in COLUMNS]
    return {
        "cells": materialize(spark.createDataFrame(cells, "table_id string, row_id long, col_ord int, col_name string, value string")),
        "scores": materialize(spark.createDataFrame(scores, "qid long, col_ord int, col_name string, llm double, sim double")),
        "votes": spark.createDataFrame(votes, "qid long, iteration int, col_name string, score double"),
        "types": spark.createDataFrame([(q, "number") for q in (1, 2, 3)], "qid long, answer_type string").withColumn(
            "type_scores", F.create_map(F.lit("number"), F.lit(0.9))
        ),
    }


def test_runs_are_taken_up_again(spark):
    path = scratch_path(spark, "runs-test")
    asked = spark.createDataFrame([(1, "a", "size of a 3"), (2, "lost", "colour"), (3, "a", "price")], "qid long, table_id string, question string")
    first = runs.run_questions(spark, path, asked.where("qid <> 3"), **inputs(spark, ["a"]))
    second = runs.run_questions(spark, path, asked, **inputs(spark, ["a"]))
    told = {r.qid: (r.run, r.status, r.reason) for r in runs.read_records(spark, path).collect()}
    assert told == {1: (first, "ok", "ok"), 2: (first, "failed", "no_table"), 3: (second, "ok", "ok")}
    # a run that broke off before its records has left rows and text
    spark.createDataFrame([(2, 1, "half a table")], "qid long, part long, text string").write.parquet(f"{path}/text/run=broken")
    third = runs.run_questions(spark, path, asked, again=True, **inputs(spark, ["a", "lost"]))
    told = {r.qid: (r.run, r.status) for r in runs.read_records(spark, path).collect()}
    assert told == {1: (first, "ok"), 2: (third, "ok"), 3: (second, "ok")}
    text = runs.read_text(spark, path).collect()
    assert sorted((r.qid, r.run, r.part) for r in text) == sorted((q, run, 1) for q, (run, _) in told.items())
    assert all("half" not in r.text for r in text)
    rows = runs.read_part(spark, path, "rows").groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in rows} == {1: 2, 2: 2, 3: 2}
    kept = {r.qid: set(r.kept) for r in runs.read_records(spark, path).collect()}
    columns = runs.read_part(spark, path, "columns").where("pos is not null").collect()
    assert {q: {c.col_name for c in columns if c.qid == q} for q in kept} == kept
    assert runs.read_part(spark, path, "votes").count() == 3 * 8

"""A user's own scorer over many questions: an error ends its question, not the run."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

OK, FAILED = "ok", "failed"
#: Characters of an error's text that are kept.
ERROR_CHARS = 500

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

Scorer = Callable[[str, list[str]], list[float]]


def workers_find_library(spark: SparkSession) -> None:
    """Workers on the driver's machine find the library where the driver does; others need it installed or in --py-files."""
    known = spark.sparkContext.environment
    if HOME not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), HOME]))


def score_columns(questions: DataFrame, columns: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores by a Python function of (question, column names): ``qid, status, error, columns``.

    ``questions(qid, question)``, ``columns(qid, col_ord, col_name)``. The function is called once per question in Arrow
    batches. What it raises, scores that are no finite numbers, and a wrong number of them make that question ``failed``, with
    the error and without scores; every question has one row. ``columns`` lists (col_ord, col_name, score). A question's
    columns are bounded by the width of its table; one without columns has none to score. Errors are caught in the task that
    has the question, so the others of its batch go on; a worker that dies is Spark's to run again.
    """
    workers_find_library(questions.sparkSession)
    names = F.sort_array(F.collect_list(F.struct("col_ord", "col_name")))
    asked = questions.select("qid", "question").join(columns.groupBy("qid").agg(names.alias("listed")), "qid", "left")
    given = asked.select("qid", "question", F.transform("listed", lambda c: c.col_name).alias("names"), "listed")
    place = len(given.columns)
    out_type = pa.struct([("status", pa.string()), ("error", pa.string()), ("scores", pa.list_(pa.float64()))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        for rows in batches:
            results = []
            for question, listed in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                listed = listed or []
                try:
                    scores = [float(s) for s in scorer(question, list(listed))] if listed else []
                    if len(scores) != len(listed):
                        raise ValueError(f"{len(scores)} scores for {len(listed)} columns")
                    if not all(map(math.isfinite, scores)):
                        raise ValueError("a score is not a finite number")
                    results.append({"status": OK, "error": None, "scores": scores})
                except Exception as error:  # noqa: BLE001  whatever a user's function raises ends its question alone
                    said = f"{type(error).__name__}: {error}"[:ERROR_CHARS]
                    results.append({"status": FAILED, "error": said, "scores": []})
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in range(place)] + [pa.array(results, out_type)], names=[*rows.schema.names, "result"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in given.dtypes)
    done = given.mapInArrow(scored, f"{kinds}, result struct<status:string,error:string,scores:array<double>>")
    pairs = F.zip_with(
        "listed", "result.scores", lambda c, s: F.struct(c.col_ord.alias("col_ord"), c.col_name.alias("col_name"), s.alias("score"))
    )
    return done.select("qid", "result.status", "result.error", F.when(F.col("result.status") == OK, pairs).alias("columns"))


def scored_columns(scored: DataFrame) -> DataFrame:
    """``qid, col_ord, col_name, score`` of the questions that went well."""
    return scored.where(F.col("status") == OK).select("qid", F.inline("columns"))

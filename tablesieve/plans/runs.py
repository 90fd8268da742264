"""Whole runs over a question set: what is left to do, the reduction, its records, and what failed, kept in one folder.

A run's folder holds ``records`` (one per question, failed ones too), ``columns`` (every column with its scores, cluster and
description), ``votes`` (the single votes), ``rows`` (the kept rows with their scores) and ``text`` (the small table in parts). Everything is written under the
name of the run; the records come last, and what has no record under its run's name does not count. So a run that broke off leaves
nothing to clean up, and the next one takes up the questions that have no record.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesieve.operators.choose import choose_cluster
from tablesieve.operators.clusters import cluster_columns
from tablesieve.operators.columns import select_columns
from tablesieve.operators.linearize import ROWS, ROWS_PER_PART, table_text
from tablesieve.operators.rows import BLOCK_ROWS, KEEP_RATIO
from tablesieve.plans.filter import kept_cells, top_filtered_rows
from tablesieve.plans.records import question_records, question_status
from tablesieve.runtime import materialize
from tablesieve.sources.results import pending

PARTS = ("columns", "votes", "rows", "text")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the folder, or nothing if no run has written it."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_questions(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    cells: DataFrame,
    scores: DataFrame,
    votes: DataFrame,
    types: DataFrame,
    essential: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    ratio: float = KEEP_RATIO,
    rows_per_part: int = ROWS_PER_PART,
    block_rows: int = BLOCK_ROWS,
    again: bool = False,
) -> str:
    """Reduces the tables of all questions without a record in ``path`` and returns the name of the run.

    ``questions(qid, table_id, question)``; ``scores`` and ``essential`` as for ``filter_tables``; ``votes(qid, iteration,
    col_name, score)``, ``types(qid, answer_type, type_scores)`` and ``descriptions(qid, col_name, description)`` go into the
    records as they are. A question whose table is unknown, or that has no scores, gets a failed record and takes no further part; with
    ``again`` such questions are tried anew. Every question asked ends with one record.
    """
    run = f"r{uuid.uuid4().hex}"
    known = stored(spark, path, "records")
    if known is not None:
        finished = known.where(F.col("status") == "ok") if again else known
        questions = pending(questions, finished)
    todo = materialize(questions, "todo")
    scores = materialize(scores.join(todo.select("qid"), "qid", "left_semi"), "run-scores")
    status = materialize(question_status(todo, cells, scores), "status")
    able = materialize(todo.join(status.where(F.col("status") == "ok").select("qid"), "qid", "left_semi"), "able")
    clusters = materialize(cluster_columns(scores.join(able.select("qid"), "qid", "left_semi")), "clusters")
    vote = materialize(choose_cluster(clusters, able), "vote")
    selected = materialize(select_columns(clusters, vote, essential), "selected").join(able.select("qid"), "qid", "left_semi")
    best = materialize(top_filtered_rows(able, cells, selected, question_vectors, row_vectors, None, block_rows, ratio), "best")

    def keep(frame: DataFrame, name: str) -> None:
        frame.write.mode("append").parquet(f"{path}/{name}/run={run}")

    columns = clusters.select("qid", "col_ord", "col_name", "llm", "sim", "cluster_id").join(
        selected.select("qid", "col_name", "pos"), ["qid", "col_name"], "left"
    )
    if descriptions is None:
        columns = columns.withColumn("description", F.lit(None).cast("string"))
    else:
        columns = columns.join(descriptions.select("qid", "col_name", "description"), ["qid", "col_name"], "left")
    keep(columns, "columns")
    keep(votes.join(able.select("qid"), "qid", "left_semi"), "votes")
    keep(best, "rows")
    keep(table_text(kept_cells(able, cells, selected, best), ["qid"], "rnk", ROWS, rows_per_part), "text")
    keep(question_records(todo, status, clusters, vote, selected, types), "records")
    return run


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The latest word on each question: a record that went well before a failed one, with the name of its ``run``."""
    records = spark.read.parquet(f"{path}/records")
    rest = [c for c in records.columns if c != "qid"]
    # a run gives a question one record; it has another only where it failed before
    order = F.struct(F.col("status") == "ok", "run")
    return records.groupBy("qid").agg(F.max_by(F.struct(*rest), order).alias("r")).select("qid", "r.*")


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of ``columns``, ``votes``, ``rows`` or ``text`` that belong to the records, by qid and run."""
    if name not in PARTS:
        raise ValueError(f"{name} is none of {', '.join(PARTS)}")
    return spark.read.parquet(f"{path}/{name}").join(read_records(spark, path).select("qid", "run"), ["qid", "run"], "left_semi")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Every question with its small table, a row per part: ``qid, question, status, reason, run, part, text``; failed ones have no part."""
    records = read_records(spark, path).select("qid", "question", "status", "reason", "run")
    return records.join(spark.read.parquet(f"{path}/text"), ["qid", "run"], "left").select(*records.columns, "part", "text")

"""Similarity of questions and column descriptions: on given vectors, and on text where a question has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions import vectors as vx
from tablesieve.operators.rows import BLOCK_ROWS, score_rows
from tablesieve.operators.votes import min_max


def description_text(col_name: Column, description: Column) -> Column:
    """Column name in plain words followed by its description, lower case."""
    return F.concat_ws(" ", F.translate(F.lower(col_name), "_", " "), F.lower(description))


def column_similarity(question_vectors: DataFrame, column_vectors: DataFrame) -> DataFrame:
    """Cosine of question and columns, scaled to 0 .. 1 within the question.

    ``question_vectors(qid, table_id, vector)``, ``column_vectors(table_id, col_ord, col_name, vector)``.
    """
    asked = question_vectors.withColumnRenamed("vector", "q_vector")
    pairs = asked.join(column_vectors, "table_id")
    product = vx.dot(F.col("q_vector"), F.col("vector"))
    raw = pairs.select(
        "qid", "col_ord", "col_name",
        vx.cosine(product, vx.norm(F.col("q_vector")), vx.norm(F.col("vector"))).alias("sim"),
    )
    return min_max(raw, "sim")


def text_similarity(questions: DataFrame, descriptions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """TF-IDF cosine of question and column descriptions, scaled to 0 .. 1 within the question: ``qid, col_ord, col_name, sim``.

    ``questions(qid, table_id, question)``, ``descriptions(table_id, col_ord, col_name, description)``; a column without
    description is its name. The descriptions of a table span the space, in which the question is one more text; all
    questions of a table share it.
    """
    columns = descriptions.select("table_id", "col_ord", "col_name", description_text(F.col("col_name"), F.col("description")).alias("text"))
    asked = questions.select("qid", F.col("table_id").alias("corpus"), "question")
    rows = columns.select(F.col("table_id").alias("corpus"), F.col("col_ord").alias("row_id"), "text")
    scores = score_rows(asked, rows, block_rows=block_rows, signals=("tfidf",))
    named = scores.select("qid", F.col("corpus").alias("table_id"), F.col("row_id").alias("col_ord"), F.col("tfidf").alias("sim"))
    named = named.join(columns.select("table_id", "col_ord", "col_name"), ["table_id", "col_ord"])
    return min_max(named.select("qid", "col_ord", "col_name", "sim"), "sim")


def question_similarity(
    questions: DataFrame, descriptions: DataFrame, question_vectors: DataFrame, column_vectors: DataFrame, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``qid, col_ord, col_name, sim, basis``: on vectors where the question and its table have them, else on text.

    The choice is made per question, as the two kinds of similarity cannot be compared within one.
    """
    known = question_vectors.where(F.col("vector").isNotNull()).join(column_vectors.select("table_id").distinct(), "table_id", "left_semi")
    by_vector = known.select("qid").distinct()
    rest = questions.join(by_vector, "qid", "left_anti")
    vectors = column_similarity(known.select("qid", "table_id", "vector"), column_vectors).withColumn("basis", F.lit("vector"))
    return vectors.unionByName(text_similarity(rest, descriptions, block_rows).withColumn("basis", F.lit("text")))


def column_scores(columns: DataFrame, votes: DataFrame, similarity: DataFrame) -> DataFrame:
    """``qid, col_ord, col_name, llm, sim``; a column without a score gets 0.

    ``columns(qid, col_ord, col_name)``, ``votes(qid, col_name, adjusted)``, ``similarity(qid, col_name, sim)``.
    """
    return (
        columns.join(votes.select("qid", "col_name", F.col("adjusted").alias("llm")), ["qid", "col_name"], "left")
        .join(similarity.select("qid", "col_name", "sim"), ["qid", "col_name"], "left")
        .select(
            "qid", "col_ord", "col_name",
            F.coalesce("llm", F.lit(0.0)).alias("llm"), F.coalesce("sim", F.lit(0.0)).alias("sim"),
        )
    )

"""The reduction with one half left out or replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesieve.operators.columns import top_norm_columns
from tablesieve.operators.linearize import ROWS_PER_PART, records
from tablesieve.operators.rows import BLOCK_ROWS, KEEP_RATIO, top_table_rows
from tablesieve.operators.selection import positions
from tablesieve.plans.filter import kept_cells, row_text
from tablesieve.sources.cells import project


def columns_only(questions: DataFrame, cells: DataFrame, selected: DataFrame) -> DataFrame:
    """All rows, selected columns: ``qid, row_id, pos, col_name, value``."""
    wanted = selected.join(questions.select("qid", "table_id"), "qid")
    return project(cells, wanted).select("qid", "row_id", "pos", "col_name", "value")


def top_all_columns(
    questions: DataFrame,
    cells: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    ratio: float = KEEP_RATIO,
) -> DataFrame:
    """The best rows on all columns, ranked; all questions of a table share its statistics."""
    rows = row_text(cells, ["table_id", "row_id"], "col_ord").withColumnRenamed("table_id", "corpus")
    asked = questions.select("qid", F.col("table_id").alias("corpus"), "question")
    if row_vectors is not None:
        row_vectors = row_vectors.withColumnRenamed("table_id", "corpus")
    return top_table_rows(asked, rows, question_vectors, row_vectors, weights, block_rows, ratio)


def rows_only(questions: DataFrame, cells: DataFrame, best: DataFrame) -> DataFrame:
    """Best rows, all columns: ``qid, rnk, pos, col_name, value``. ``best`` as from ``top_all_columns``."""
    placed = best.select("qid", "row_id", "rnk").join(questions.select("qid", "table_id"), "qid")
    return cells.join(placed, ["table_id", "row_id"]).select(
        "qid", "rnk", F.col("col_ord").alias("pos"), "col_name", "value"
    )


def top_columns(questions: DataFrame, cells: DataFrame, scores: DataFrame, kept_rows: DataFrame) -> DataFrame:
    """Columns by score length in place of clusters, on the row picks of the full run."""
    return kept_cells(questions, cells, top_norm_columns(scores), kept_rows)


def by_position(cells: DataFrame, order: str) -> DataFrame:
    """Cells with ``place``, the position of their row in the question's own table, from 0."""
    rows = cells.select("qid", order).distinct()
    if order == "rnk":
        places = rows.withColumn("place", F.col("rnk") - 1)
    else:
        places = positions(rows, "qid", order)
    return cells.join(places, ["qid", order])


def side_by_side(
    questions: DataFrame,
    columns_cells: DataFrame,
    rows_cells: DataFrame,
    top_cells: DataFrame,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Per question the three tables as JSON arrays, ``rows_per_part`` rows of each side by side.

    ``questions(qid, question, answer)``. Rows are numbered by their position in their own table, so a part holds
    the same stretch of all three; where a table has ended, its text is null. ``top_columns`` names the columns
    that were chosen by score length.
    """
    names = F.sort_array(F.collect_set(F.struct("pos", "col_name")))
    chosen = top_cells.select("qid", "pos", "col_name").distinct().groupBy("qid").agg(
        F.transform(names, lambda c: c.col_name).alias("top_columns")
    )
    out = None
    for cells, order, name in (
        (columns_cells, "row_id", "column_filtered"), (rows_cells, "rnk", "row_filtered"), (top_cells, "rnk", "top_filtered"),
    ):
        table = records(by_position(cells, order), ["qid"], "place", rows_per_part).withColumnRenamed("text", name)
        out = table if out is None else out.join(table, ["qid", "part"], "full")
    return out.join(questions.select("qid", "question", "answer"), "qid").join(chosen, "qid", "left")

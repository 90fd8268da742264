"""The whole reduction: columns, then rows, then the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesieve.functions.text import joined, shown, space_tokens
from tablesieve.operators.choose import choose_cluster
from tablesieve.operators.clusters import cluster_columns
from tablesieve.operators.columns import select_columns
from tablesieve.operators.rows import BLOCK_ROWS, KEEP_RATIO, rank_scores, score_postings, tokens, top_scores, with_length
from tablesieve.runtime import materialize


def filter_columns(scores: DataFrame, questions: DataFrame, essential: DataFrame | None = None) -> DataFrame:
    """Scores to clusters to vote to columns: ``qid, pos, col_ord, col_name``."""
    clusters = materialize(cluster_columns(scores), "clusters")
    return select_columns(clusters, choose_cluster(clusters, questions), essential)


def row_text(cells: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Cells of each row joined by a space; a missing value is written out."""
    items = F.collect_list(F.struct(F.col(order), shown(F.col("value")).alias("value")))
    return cells.groupBy(*keys).agg(joined(items, " ", order, "value").alias("text"))


def corpora(questions: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that keep the same columns of the same table share one corpus.

    Returns questions with ``corpus`` and the columns of each corpus: ``corpus, table_id, pos, col_name``.
    """
    columns = F.transform(F.sort_array(F.collect_list(F.struct("pos", "col_name"))), lambda c: c.col_name)
    per_question = selected.groupBy("qid").agg(columns.alias("names"))
    keyed = questions.join(per_question, "qid").withColumn(
        "corpus", F.concat_ws("#", "table_id", F.sha2(F.to_json("names"), 256))
    )
    distinct = keyed.select("corpus", "table_id", "names").dropDuplicates(["corpus"])
    listed = distinct.select("corpus", "table_id", F.posexplode_outer("names").alias("pos", "col_name"))
    return keyed.drop("names"), listed


def corpus_postings(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Postings of the rows of each corpus, summed over its columns: ``corpus, row_id, kind, term, tf, len``.

    A token never crosses the border of a cell, so every cell is tokenised once, however many corpora
    read its column.
    """
    keys = ["table_id", "row_id", "col_name"]
    texts = cells.select(*keys, shown(F.col("value")).alias("text")).repartition(*keys)
    terms = tokens(texts, keys, "text").groupBy(*keys, "kind", "term").agg(F.count("*").alias("tf"))
    wanted = materialize(terms, "cell-terms").join(columns, ["table_id", "col_name"]).repartition("corpus", "row_id")
    return with_length(wanted.groupBy("corpus", "row_id", "kind", "term").agg(F.sum("tf").alias("tf")))


def score_filtered_rows(
    questions: DataFrame,
    cells: DataFrame,
    selected: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Scores of the rows of each question's table on the selected columns alone, as ``score_rows``.

    ``row_vectors(table_id, row_id, vector)``.
    """
    asked, columns = corpora(questions, selected)
    counted = materialize(corpus_postings(cells, columns), "postings")
    if row_vectors is not None:
        tables = columns.select("corpus", "table_id").distinct()
        row_vectors = row_vectors.join(tables, "table_id").select("corpus", "row_id", "vector")
    return score_postings(asked.select("qid", "corpus", "question"), counted, question_vectors, row_vectors, block_rows)


def rank_filtered_rows(
    questions: DataFrame,
    cells: DataFrame,
    selected: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows of each question ranked on the selected columns: ``qid, row_id, tfidf, bm25, dense, fusion, n, rnk``."""
    return rank_scores(score_filtered_rows(questions, cells, selected, question_vectors, row_vectors, block_rows), weights)


def top_filtered_rows(
    questions: DataFrame,
    cells: DataFrame,
    selected: DataFrame,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    ratio: float = KEEP_RATIO,
) -> DataFrame:
    """The best ``ratio`` of ``rank_filtered_rows``, without sorting the others."""
    return top_scores(score_filtered_rows(questions, cells, selected, question_vectors, row_vectors, block_rows), weights, ratio)


def kept_cells(questions: DataFrame, cells: DataFrame, selected: DataFrame, kept_rows: DataFrame) -> DataFrame:
    """Chosen columns of the kept rows: ``qid, rnk, pos, col_name, value``.

    ``selected(qid, pos, col_name)``, ``kept_rows(qid, row_id, rnk)``.
    """
    placed = kept_rows.select("qid", "row_id", "rnk").join(questions.select("qid", "table_id"), "qid")
    in_rows = cells.select("table_id", "row_id", "col_name", "value").join(placed, ["table_id", "row_id"])
    return in_rows.join(selected.select("qid", "pos", "col_name"), ["qid", "col_name"]).select(
        "qid", "rnk", "pos", "col_name", "value"
    )


def filter_tables(
    questions: DataFrame,
    cells: DataFrame,
    scores: DataFrame,
    essential: DataFrame | None = None,
    question_vectors: DataFrame | None = None,
    row_vectors: DataFrame | None = None,
    ratio: float = KEEP_RATIO,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The reduced table of every question as cells: ``qid, rnk, pos, col_name, value``.

    ``questions(qid, table_id, question)``, ``scores(qid, col_ord, col_name, llm, sim)``.
    """
    selected = materialize(filter_columns(scores, questions, essential), "columns")
    best = top_filtered_rows(questions, cells, selected, question_vectors, row_vectors, weights, block_rows, ratio)
    return kept_cells(questions, cells, selected, best)


def reduction(questions: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells and white-space tokens of each question's table before and after."""
    tokens = F.size(space_tokens(F.coalesce("value", F.lit("None"))))
    raw = cells.groupBy("table_id").agg(F.count("*").alias("raw_cells"), F.sum(tokens).alias("raw_tokens"))
    small = kept.groupBy("qid").agg(F.count("*").alias("kept_cells"), F.sum(tokens).alias("kept_tokens"))
    sizes = questions.select("qid", "table_id").join(raw, "table_id", "left").join(small, "qid", "left")
    sizes = sizes.select(
        "qid", "table_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_cells", "raw_tokens", "kept_cells", "kept_tokens")]
    )
    return sizes.withColumn(
        "cell_ratio", F.when(F.col("raw_cells") > 0, F.col("kept_cells") / F.col("raw_cells"))
    ).withColumn("token_ratio", F.when(F.col("raw_tokens") > 0, F.col("kept_tokens") / F.col("raw_tokens")))

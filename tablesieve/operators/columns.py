"""The columns kept for a question, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tablesieve.operators.choose import mean_score, settled

ROW_HEADER = "Row Header"  # fixed value: a column of this name is always kept


def best_of_others(clusters: DataFrame, choice: DataFrame, count: int = 1) -> DataFrame:
    """The best columns of each cluster that was not chosen."""
    best = W.partitionBy("qid", "cluster_id").orderBy(F.desc(settled(mean_score())), "col_ord")
    return (
        clusters.join(choice.select("qid", "selected"), "qid")
        .where(F.col("cluster_id") != F.col("selected"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= count)
    )


def select_columns(clusters: DataFrame, choice: DataFrame, essential: DataFrame | None = None) -> DataFrame:
    """Chosen cluster, best of the others, essential columns, row header: ``qid, pos, col_ord, col_name``.

    ``essential(qid, ess_ord, col_name)`` lists columns that exist in the table. A column wanted for
    several reasons takes its first place.
    """
    every = clusters.select("qid", "col_ord", "col_name")
    chosen = clusters.join(choice.select("qid", "selected"), "qid").where(F.col("cluster_id") == F.col("selected"))

    def reason(frame: DataFrame, number: int, first, second) -> DataFrame:
        return frame.select(
            "qid", "col_ord", "col_name", F.struct(F.lit(number).alias("a"), first.alias("b"), second.alias("c")).alias("o")
        )

    nothing = F.lit(0).cast("long")
    wanted = reason(chosen, 0, F.col("col_ord").cast("long"), nothing).unionByName(
        reason(best_of_others(clusters, choice), 1, F.col("cluster_id").cast("long"), F.col("place").cast("long"))
    )
    if essential is not None:
        listed = every.join(essential, ["qid", "col_name"])
        wanted = wanted.unionByName(reason(listed, 2, F.col("ess_ord").cast("long"), nothing))
    header = every.where(F.col("col_name") == ROW_HEADER)
    wanted = wanted.unionByName(reason(header, 3, nothing, nothing))
    first = wanted.groupBy("qid", "col_ord", "col_name").agg(F.min("o").alias("o"))
    return first.select(
        "qid", F.row_number().over(W.partitionBy("qid").orderBy("o")).alias("pos"), "col_ord", "col_name"
    )


def top_norm_columns(scores: DataFrame, few: int = 10, top: int = 3, share: float = 0.6) -> DataFrame:
    """Columns by the length of their score vector: the top three of a narrow table, and from the
    60th percentile upward in a table of at least ten columns."""
    length = F.round(F.sqrt(F.col("llm") * F.col("llm") + F.col("sim") * F.col("sim")), 12)
    question = W.partitionBy("qid")
    sized = scores.withColumn("length", length)
    stats = sized.groupBy("qid").agg(F.count("*").alias("cols"), F.percentile("length", F.lit(share)).alias("cut"))
    placed = sized.withColumn("place", F.row_number().over(question.orderBy(F.desc("length"), "col_ord")))
    wide = F.col("cols") >= few
    kept = placed.join(stats, "qid").where(
        (wide & (settled(F.col("length")) >= settled(F.col("cut")))) | (~wide & (F.col("place") <= top))
    )
    order = F.when(wide, F.col("col_ord")).otherwise(F.col("place"))
    return kept.select(
        "qid", F.row_number().over(question.orderBy(order)).alias("pos"), "col_ord", "col_name", "length"
    )

"""Relevance votes: repeated scores of the columns of a question, combined into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def fill_votes(columns: DataFrame, votes: DataFrame) -> DataFrame:
    """Every column of a question in every iteration that has votes; a missing vote counts 0.

    ``columns(qid, col_ord, col_name)``, ``votes(qid, iteration, col_name, score)``.
    """
    rounds = votes.select("qid", "iteration").distinct()
    return (
        columns.join(rounds, "qid")
        .join(votes, ["qid", "iteration", "col_name"], "left")
        .select("qid", "iteration", "col_ord", "col_name", F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def rank_votes(filled: DataFrame) -> DataFrame:
    """Rank of each column in its iteration, scaled to 1/n .. 1; equal scores in column order."""
    one_round = W.partitionBy("qid", "iteration")
    place = F.row_number().over(one_round.orderBy("score", "col_ord"))
    return filled.withColumn("norm_rank", place / F.count("*").over(one_round))


def median_rank(filled: DataFrame) -> DataFrame:
    """Median scaled rank of each column over the iterations."""
    return rank_votes(filled).groupBy("qid", "col_ord", "col_name").agg(F.median("norm_rank").alias("median_rank"))


def reliable_scores(filled: DataFrame) -> DataFrame:
    """Mean vote, its spread, and the mean damped by the spread."""
    stats = filled.groupBy("qid", "col_ord", "col_name").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    reliability = 1 / (1 + F.col("std"))
    return stats.withColumn("reliability", reliability).withColumn("adjusted", F.col("mean") * reliability)


def min_max(scores: DataFrame, column: str, by: str = "qid") -> DataFrame:
    """Scale ``column`` to 0 .. 1 within each question; a flat question keeps its values."""
    low, high = F.min(column).over(W.partitionBy(by)), F.max(column).over(W.partitionBy(by))
    value = F.col(column)
    return scores.withColumn(column, F.when(high > low, (value - low) / (high - low)).otherwise(value))

"""Exact match and F1 of answer sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions.text import trimmed

FAILED = "failed"


def normalized(answers: Column) -> Column:
    """Distinct answers, lower case and trimmed; a missing answer reads ``none``."""
    return F.array_distinct(F.transform(answers, lambda a: trimmed(F.lower(F.coalesce(a, F.lit("None"))))))


def em_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, method, em, f1`` for predicted(qid, method, answers, status) and gold(qid, answers).

    A failed method counts as 0 in both.
    """
    sets = predicted.select("qid", "method", "status", normalized(F.col("answers")).alias("p")).join(
        gold.select("qid", normalized(F.col("answers")).alias("g")), "qid"
    )
    shared = F.size(F.array_intersect("p", "g"))
    both = F.size("p") + F.size("g")
    ran = F.coalesce(F.col("status") != FAILED, F.lit(True))
    equal = (shared == F.size("p")) & (shared == F.size("g"))
    return sets.select(
        "qid", "method",
        F.when(ran & equal, 1).otherwise(0).alias("em"),
        F.when(ran & (shared > 0), 2 * shared / both).otherwise(0.0).alias("f1"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """Mean EM and F1 of each method."""
    return scores.groupBy("method").agg(
        F.coalesce(F.avg("em"), F.lit(0.0)).alias("em"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1")
    )

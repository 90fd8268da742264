"""Batch evaluation: responses of any number of methods against the gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesieve.operators import evaluate, responses as rs


def score_responses(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, method, em, f1`` for responses(qid, method, text, status) and gold(qid, answers)."""
    return evaluate.em_f1(rs.answers(responses), gold)


def evaluate_methods(responses: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean EM and F1 per method."""
    return evaluate.summary(score_responses(responses, gold))

"""Question features, as expressions on the question text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablesieve.functions.text import space_tokens

# Words and weights the features are defined by.
AGGREGATE_WORDS = ["sum", "count", "average", "total", "maximum", "minimum"]
NESTED_WORDS = ["in", "exists"]
CONDITION_PATTERN = r"\b(and|or)\b"
TYPE_RULES = {
    "aggregation": ["sum", "total", "count", "average", "max", "min"],
    "filtering": ["where", "filter", "condition", "specific"],
    "exploration": ["show", "list", "display", "all"],
    "comparison": ["compare", "difference", "versus"],
}
OTHER_TYPE = "general"


def complexity(question: Column) -> Column:
    """Word count and clause words as one number, at most 3."""
    words = space_tokens(question)

    def bonus(test: Column, amount: float) -> Column:
        return F.when(test, F.lit(amount)).otherwise(F.lit(0.0))

    def has_any(listed: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))

    score = (
        F.size(words) / F.lit(10.0)
        + bonus(F.lower(question).rlike(CONDITION_PATTERN), 0.5)
        + bonus(has_any(AGGREGATE_WORDS), 0.3)
        + bonus(has_any(NESTED_WORDS), 0.7)
    )
    return F.least(score, F.lit(3.0))


def question_type(question: Column) -> Column:
    """First type one of whose words occurs anywhere in the question, inside words too."""
    text = F.lower(question)
    rule = F
    for name, listed in TYPE_RULES.items():
        rule = rule.when(text.rlike("|".join(listed)), name)
    return rule.otherwise(OTHER_TYPE)


def type_weight(kind: Column, size: Column) -> Column:
    """How well a cluster of ``size`` columns suits a type of question."""
    return (
        F.when(kind == "aggregation", F.when(size <= 5, 0.8).otherwise(0.6))
        .when(kind == "filtering", 1.0)
        .when(kind == "exploration", F.when(size >= 5, 0.6).otherwise(0.8))
        .when(kind == "comparison", 0.9)
        .otherwise(0.7)
    )


def size_match(size: Column, complexity_score: Column) -> Column:
    """Closeness of a cluster's size to three columns per unit of complexity, ten at most."""
    return 1 / (1 + 0.2 * F.abs(size - F.least(complexity_score * 3, F.lit(10.0))))

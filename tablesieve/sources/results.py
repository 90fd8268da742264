"""Result records: append, read, last record wins, resume, failed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCORE_SCHEMA = "`index` long, model string, EM int, F1 double"


def round_scores(df: DataFrame, digits: int = 4) -> DataFrame:
    """Score columns rounded for output; other columns keep type and value."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def append_results(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_scores(df: DataFrame, path: str) -> None:
    """Append evaluation rows as CSV with a header."""
    df.write.mode("append").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).csv(path, header=True)


def last_results(records: DataFrame, key: str = "qid", order: str = "run_seq") -> DataFrame:
    """The latest record of each key. Records are reduced before they are shuffled."""
    rest = [c for c in records.columns if c != key]
    return (
        records.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("r"))
        .select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def pending(todo: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """Items without a record. ``done`` may hold any number of records per key."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def split_failures(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that went well and items with an ``error``."""
    return items.where(F.col("error").isNull()).drop("error"), items.where(F.col("error").isNotNull())

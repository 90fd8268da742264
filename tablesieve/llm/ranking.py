"""Places of rows within groups of any size, without sorting a group in one task.

Rows of a group fall into buckets by the order they are to be numbered in, about sqrt(n) where the group, or the table, has n
rows. Counts per (group, bucket) are pre-aggregated and summed up along the buckets; within a bucket rows are numbered by a
window. The sums of a group are at most as many as its buckets, and a bucket has about sqrt(n) of its rows, however much of the table
one group holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket_count(rows: int) -> int:
    return max(1, math.isqrt(rows))


def bucket_totals(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """``group..., bucket, before, total``: rows of the group in earlier buckets, and in all."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*group)
    earlier = whole.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *group, bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"), F.sum("_n").over(whole).alias("total")
    )


def numbered(rows: DataFrame, group: list[str], bucket: str, order: list[str | Column]) -> DataFrame:
    """Adds ``place`` (from 0 within the group, by bucket and then ``order``) and ``total``.

    ``rows`` is read twice: pass a written table. ``group`` and ``bucket`` must not hold nulls. Rows that are
    equal in ``order`` should be interchangeable, as their places among themselves are open.
    """
    keys = [*group, bucket]
    inside = rows.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (
        inside.join(bucket_totals(rows, group, bucket), keys)
        .withColumn("place", F.col("before") + F.col("_row") - 1)
        .drop("_row", "before")
    )

"""Table profiles from cells(table_id, row_id, col_ord, col_name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

EXAMPLES = 5


def table_shape(cells: DataFrame) -> DataFrame:
    """``table_id, rows, cols, cells, names``; names in column order. One pass, counts per column first."""
    columns = cells.groupBy("table_id", "col_ord", "col_name").agg(F.count("*").alias("rows"))
    named = F.sort_array(F.collect_list(F.struct("col_ord", "col_name")))
    return (
        columns.groupBy("table_id")
        .agg(F.max("rows").alias("rows"), F.count("*").alias("cols"), named.alias("names"))
        .select(
            "table_id", "rows", "cols", (F.col("rows") * F.col("cols")).alias("cells"),
            F.transform("names", lambda c: c.col_name).alias("names"),
        )
    )


def value_counts(cells: DataFrame) -> DataFrame:
    """How often each value occurs in each column, nulls left out."""
    return (
        cells.where(F.col("value").isNotNull())
        .groupBy("table_id", "col_ord", "col_name", "value")
        .agg(F.count("*").alias("n"))
    )


def column_examples(cells: DataFrame, count: int = EXAMPLES) -> DataFrame:
    """Up to ``count`` values per column, the most frequent first, equal counts by value."""
    best = W.partitionBy("table_id", "col_ord", "col_name").orderBy(F.desc("n"), "value")
    top = value_counts(cells).withColumn("place", F.row_number().over(best)).where(F.col("place") <= count)
    listed = F.sort_array(F.collect_list(F.struct("place", "value")))
    return top.groupBy("table_id", "col_ord", "col_name").agg(
        F.transform(listed, lambda v: v.value).alias("examples")
    )


def example_text(examples):
    """`` (Examples: a, b)``, or nothing when a column has no values."""
    return F.when(
        F.size(examples) > 0, F.concat(F.lit(" (Examples: "), F.array_join(examples, ", "), F.lit(")"))
    ).otherwise("")


def column_blocks(cells: DataFrame) -> DataFrame:
    """``examples`` and ``block`` of each column: its values, and one line of its name followed by them."""
    columns = cells.groupBy("table_id", "col_ord", "col_name").agg(F.count("value").alias("values"))
    return columns.join(column_examples(cells), ["table_id", "col_ord", "col_name"], "left").select(
        "table_id", "col_ord", "col_name", "examples",
        F.concat("col_name", F.coalesce(example_text(F.col("examples")), F.lit(""))).alias("block"),
    )

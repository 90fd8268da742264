"""Cells stored by table, so that a question set reads the tables it asks for.

A folder of cells is partitioned by a hash of the table id. Within a bucket the files are sorted by table, so that a
reader skips the tables that share the bucket by the least and greatest ids of a row group. A join with a question set prunes the
buckets while the query runs, from the ids asked. A table of any size is several files of its bucket, cut by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 256
#: A file of a bucket holds about so many cells.
SLICE_CELLS = 20_000_000

SCHEMA = "table_id string, row_id long, col_ord int, col_name string, value string, bucket int"


def bucket_of(table_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(table_id), F.lit(buckets)).cast("int")


def store_cells(cells: DataFrame, path: str, buckets: int = BUCKETS, slice_cells: int = SLICE_CELLS, mode: str = "errorifexists") -> None:
    """Writes cells(table_id, row_id, col_ord, col_name, value); ``cells`` is counted first, so pass a written table.

    ``mode`` "append" adds tables to a folder of the same number of buckets.
    """
    slices = -(-max(1, cells.count()) // slice_cells)
    placed = cells.select("table_id", "row_id", "col_ord", "col_name", "value", bucket_of(F.col("table_id"), buckets).alias("bucket"))
    placed = placed.repartition("bucket", F.pmod(F.xxhash64("row_id"), F.lit(slices)))
    placed.sortWithinPartitions("bucket", "table_id", "row_id", "col_ord").write.partitionBy("bucket").mode(mode).parquet(path)


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """All stored cells, with their bucket."""
    return spark.read.schema(SCHEMA).parquet(path)


def fetch_stored(spark: SparkSession, path: str, questions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Cells of each question's table: ``table_id, row_id, col_ord, col_name, value, qid``, as ``cells.fetch_tables``.

    A question without a table id asks for nothing. Where the questions are few enough to be broadcast, only the buckets of
    their tables are read.
    """
    asked = questions.select("qid", "table_id").where(F.length("table_id") > 0)
    asked = asked.withColumn("bucket", bucket_of(F.col("table_id"), buckets))
    return stored_cells(spark, path).join(asked, ["bucket", "table_id"]).drop("bucket")

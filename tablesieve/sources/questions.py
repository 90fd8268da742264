"""Question sets kept as column-oriented JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesieve.functions.text import json_value

FIELDS = ("question", "answer", "original_table_id")  # fixed values: field names of the format


def table_name(table_id: Column) -> Column:
    """Name under which the table of a question is stored."""
    return F.concat(F.lit("table_"), F.translate(table_id, "-", "_"))


def answer_array(raw: Column) -> Column:
    """An answer given as a scalar or as a JSON list, as ARRAY<STRING>."""
    return F.coalesce(F.when(raw.startswith("["), json_value(raw, "array<string>")), F.array(raw))


def field_entries(name: str) -> Column:
    """Entries of one field as (field, index, value)."""
    found = F.transform(
        F.map_entries(F.col("fields").getField(name)),
        lambda e: F.struct(F.lit(name).alias("field"), e.key.alias("index"), e.value.alias("value")),
    )
    return F.coalesce(found, F.array().cast("array<struct<field:string,index:string,value:string>>"))


def read_questions(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``qid, table_id, question, answers`` from files of ``{field: {index: value}}`` documents.

    One document per line; ``whole_files`` reads documents that span lines, one per file.
    """
    text = spark.read.text(path, wholetext=whole_files).withColumn("doc", F.monotonically_increasing_id())
    fields = F.from_json("value", "struct<" + ",".join(f"{f}:map<string,string>" for f in FIELDS) + ">")
    flat = text.select("doc", fields.alias("fields")).select(
        "doc", F.inline_outer(F.concat(*[field_entries(f) for f in FIELDS]))
    )
    wide = flat.where(F.col("index").isNotNull()).groupBy("doc", "index").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    )
    return wide.select(
        F.col("index").cast("long").alias("qid"),
        table_name(F.col("original_table_id")).alias("table_id"),
        "question",
        answer_array(F.col("answer")).alias("answers"),
    )

"""Question sets kept as one JSON document of any size: ``{field: {index: value, ...}, ...}``.

Reading such a file as one record would need one task that holds all of it. Here the file is read in pieces that end at
quotation marks, by any number of tasks. Which piece is inside a string follows from the number of marks before it, a running sum
over totals per block of the file; what is a field, an index or a value follows from the depth of braces before it, another
one. What comes together in one place is one string, and then one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tablesieve.functions.text import json_value
from tablesieve.runtime import materialize
from tablesieve.sources.questions import FIELDS, answer_array, table_name

PLACE = ["block", "at"]


def before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all earlier rows of the same file; ``rows(file, block, at, ...)`` is read twice.

    A block is what one task reads of a file. Rows of a block stream through one window; beyond it only totals per block
    are added up.
    """
    here = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("file", "block").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = totals.select("file", "block", *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}") for n in sums])
    inside = rows.select("*", *[F.coalesce(F.sum(c).over(here), zero).alias(n) for n, c in sums.items()])
    return inside.join(starts, ["file", "block"]).select(
        *rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]
    )


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """Strings and what stands between them: ``file, block, at, no, text``, written down.

    Odd numbers are strings, as they are written; even numbers are what stands outside of strings. ``block, at`` is where a token begins.
    """
    pieces = spark.read.option("lineSep", '"').text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # a mark after an odd number of backslashes belongs to the string
    slashes = F.length(F.regexp_extract("value", r"(\\*)$", 1))
    pieces = materialize(pieces.withColumn("ends", F.when(slashes % 2 == 0, 1).otherwise(0)), "pieces")
    numbered = before(pieces, {"no": F.col("ends")})
    parts = F.sort_array(F.collect_list(F.struct(*PLACE, "value")))
    grouped = numbered.groupBy("file", "no").agg(F.min(F.struct(*PLACE)).alias("first"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p.value), '"')
    return materialize(grouped.select("file", "first.block", "first.at", "no", text.alias("text")), "tokens")


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of every field: ``file, field, index, value``, the value as the JSON text it is written as."""
    found = tokens(spark, path)
    outside = F.col("no") % 2 == 0
    opened = F.when(outside, count_of(F.col("text"), "{[") - count_of(F.col("text"), "}]")).otherwise(0)
    # a string is a name if a colon comes after it
    following = found.select("file", (F.col("no") - 1).alias("no"), F.col("text").rlike(r"^\s*:").alias("named"))
    deep = before(found, {"depth": opened}).join(following, ["file", "no"], "left")
    name = ~outside & F.coalesce("named", F.lit(False))
    kind = F.when(name & (F.col("depth") == 1), "field").when(name & (F.col("depth") == 2), "index").otherwise("value")
    deep = materialize(deep.withColumn("kind", kind), "deep")
    numbered = before(
        deep, {"fields": F.when(F.col("kind") == "field", 1).otherwise(0), "names": F.when(F.col("kind") != "value", 1).otherwise(0)}
    )
    # names count themselves, so a name and the values after it have the same number
    own = (F.col("kind") != "value").cast("int")
    numbered = numbered.select("file", "no", "text", "kind", (F.col("names") + own).alias("entry"), (F.col("fields") + (F.col("kind") == "field").cast("int")).alias("field_no"))
    numbered = materialize(numbered, "entries")
    fields = numbered.where(F.col("kind") == "field").select("file", "field_no", F.col("text").alias("field"))
    written = F.when(F.col("no") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit('"'), F.col("text"), F.lit('"')))
    listed = F.sort_array(F.collect_list(F.when(F.col("kind") == "value", F.struct("no", written.alias("text")))))
    entries = numbered.groupBy("file", "entry").agg(
        F.max(F.when(F.col("kind") != "value", F.struct("kind", "text", "field_no"))).alias("name"),
        F.array_join(F.transform(listed, lambda v: v.text), "").alias("body"),
    )
    # what comes next says what is left of the braces and commas after a value
    after = entries.select("file", (F.col("entry") - 1).alias("entry"), F.col("name.kind").alias("next"))
    closing = F.when(F.col("next") == "index", r"\s*,\s*$").when(F.col("next") == "field", r"\s*\}\s*,\s*$").otherwise(r"\s*\}\s*\}\s*$")
    body = F.regexp_replace(F.regexp_replace("body", closing, F.lit("")), F.lit(r"^\s*:\s*"), F.lit(""))
    return (
        entries.where(F.col("name.kind") == "index").join(after, ["file", "entry"], "left")
        .select("file", F.col("name.field_no").alias("field_no"), F.col("name.text").alias("index"), body.alias("value"))
        .join(fields, ["file", "field_no"])
        .select("file", "field", json_value(F.concat(F.lit('"'), F.col("index"), F.lit('"')), "string").alias("index"), "value")
    )


def read_large_questions(spark: SparkSession, path: str) -> DataFrame:
    """``qid, table_id, question, answers`` of column-oriented documents, one per file, of any size and over any lines.

    As ``questions.read_questions``, without a task that holds a document.
    """
    entries = read_entries(spark, path).withColumn("text", json_value(F.col("value"), "string"))
    wide = entries.groupBy("file", "index").agg(*[F.max(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in FIELDS])
    return wide.select(
        F.col("index").cast("long").alias("qid"), table_name(F.col("original_table_id")).alias("table_id"), "question",
        answer_array(F.col("answer")).alias("answers"),
    )

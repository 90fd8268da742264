"""Tables as text and as records.

A table of any length is written in parts of ``ROWS_PER_PART`` rows, so that no string grows with the
table; the parts of a key, put together in order, are the whole text. Part 0 is the header line of the
forms that have one. ``cells`` hold ``keys..., order, pos, col_name, value``: ``order`` places a row
(rank or row id, unique per table), ``pos`` places a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions.text import joined, shown

ROWS_PER_PART = 1000
NO_TABLE = "[No Table]"  # fixed value


@dataclass(frozen=True)
class Form:
    """How cells and rows are put together. ``after`` ends every row, otherwise ``between`` separates rows."""

    cell_break: str
    between: str = ""
    after: str = ""
    named: bool = False
    header: bool = False


# The text forms.
ROWS = Form(cell_break="; ", between=" | ", named=True)
HEADER = Form(cell_break=" | ", between="\n", header=True)
FLAT = Form(cell_break=" | ", after=" ", header=True)
TSV = Form(cell_break="\t", after="\n", header=True)


def part_of(order: Column, rows_per_part: int) -> Column:
    return (F.floor(order / F.lit(rows_per_part)) + 1).cast("long")


def row_lines(cells: DataFrame, keys: list[str], order: str, form: Form) -> DataFrame:
    """One line per row: ``keys..., order, line``. A row holds the cells of one table row."""
    value = shown(F.col("value"))
    piece = F.concat("col_name", F.lit(": "), value) if form.named else value
    items = F.collect_list(F.struct(F.col("pos"), piece.alias("piece")))
    return cells.groupBy(*keys, order).agg(joined(items, form.cell_break, "pos", "piece").alias("line"))


def pack_lines(lines: DataFrame, keys: list[str], order: str, between: str, rows_per_part: int) -> DataFrame:
    """Lines in order, ``rows_per_part`` to a part: ``keys..., part, text``."""
    items = F.collect_list(F.struct(F.col(order), F.col("line")))
    return (
        lines.withColumn("part", part_of(F.col(order), rows_per_part))
        .groupBy(*keys, "part")
        .agg(joined(items, between, order, "line").alias("text"))
    )


def table_text(
    cells: DataFrame, keys: list[str], order: str, form: Form = ROWS, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Text of each table in parts: ``keys..., part, text``."""
    lines = row_lines(cells, keys, order, form)
    if form.after:
        lines = lines.withColumn("line", F.concat("line", F.lit(form.after)))
    parts = pack_lines(lines, keys, order, form.between, rows_per_part)
    if not form.header:
        return parts
    columns = cells.groupBy(*keys, "pos", "col_name").agg(F.count("*").alias("rows"))
    names = joined(F.collect_list(F.struct("pos", "col_name")), form.cell_break, "pos", "col_name")
    head = columns.groupBy(*keys).agg(F.concat(names, F.lit(form.after)).alias("text"))
    return parts.unionByName(head.withColumn("part", F.lit(0).cast("long")))


def or_no_table(parts: DataFrame, cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the wanted tables; a table without rows reads ``[No Table]``.

    Whether a table has rows is seen from its cells, so the text is made once and for nothing else.
    """
    wanted = wanted.select(*keys).distinct()
    empty = wanted.join(cells.select(*keys).distinct(), keys, "left_anti")
    found = parts.join(wanted, keys, "left_semi").select(*keys, "part", "text")
    return found.unionByName(empty.withColumn("part", F.lit(0).cast("long")).withColumn("text", F.lit(NO_TABLE)))


def records(
    cells: DataFrame, keys: list[str], order: str, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Rows as JSON records, in arrays of ``rows_per_part``: ``keys..., part, text``."""
    entries = F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "col_name", "value"))),
        lambda c: F.struct(c.col_name.alias("key"), c.value.alias("value")),
    )
    record = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    lines = cells.groupBy(*keys, order).agg(record.alias("line"))
    parts = pack_lines(lines, keys, order, ",", rows_per_part)
    return parts.withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))


def context_text(questions: DataFrame, parts: DataFrame, descriptions: DataFrame, template: tuple[str, str, str]) -> DataFrame:
    """Table text with question and column descriptions around it, in parts: ``qid, part, text``.

    ``template`` is the text before the table, between table and question, and before the descriptions;
    ``descriptions(qid, pos, col_name, description)``. Part 0 opens, the last part closes.
    """
    before, middle, listing = template
    line = F.concat(F.lit("- "), "col_name", F.lit(": "), "description")
    described = descriptions.groupBy("qid").agg(
        joined(F.collect_list(F.struct(F.col("pos"), line.alias("line"))), "\n", "pos", "line").alias("listed")
    )
    last = parts.groupBy("qid").agg((F.max("part") + 1).alias("last"))
    base = questions.select("qid", "question").join(last, "qid", "left").join(described, "qid", "left")
    opening = base.select("qid", F.lit(0).cast("long").alias("part"), F.lit(before).alias("text"))
    tail = F.when(F.col("listed").isNotNull(), F.concat(F.lit(listing), "listed")).otherwise("")
    closing = base.select(
        "qid", F.coalesce("last", F.lit(1)).alias("part"), F.concat(F.lit(middle), "question", tail).alias("text")
    )
    return opening.unionByName(parts.select("qid", "part", "text")).unionByName(closing)

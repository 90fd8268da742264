"""Tables of any schema as one frame of cells: ``table_id, row_id, col_ord, col_name, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions.text import cell_text


def cells_from_table(df: DataFrame, table_id: Column, row_id: Column, columns: list[str] | None = None) -> DataFrame:
    """Cells of a wide table, columns in the order given. Narrow: nothing is shuffled."""
    columns = df.columns if columns is None else columns
    types = {f.name: f.dataType for f in df.schema}
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("col_ord"), F.lit(c).alias("col_name"),
                cell_text(F.col(f"`{c}`"), types[c]).alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.select(table_id.alias("table_id"), row_id.alias("row_id"), F.inline(cells))


def fetch_tables(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of each question's table, with ``qid``; a table may be asked by many questions."""
    return cells.join(questions.select("qid", "table_id"), "table_id")


def table_status(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """``qid, table_id, rows, status``: ``no_table`` where the table is unknown, which reads as empty."""
    per_column = cells.groupBy("table_id", "col_ord").agg(F.count("*").alias("rows"))
    sizes = per_column.groupBy("table_id").agg(F.max("rows").alias("rows"))
    return questions.join(sizes, "table_id", "left").select(
        "qid", "table_id", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNull(), "no_table").otherwise("ok").alias("status"),
    )


def lookup(coordinates: DataFrame, cells: DataFrame) -> DataFrame:
    """Values at given places: coordinates(qid, table_id, row_id, col_ord)."""
    return coordinates.join(cells, ["table_id", "row_id", "col_ord"])


def project(cells: DataFrame, selected: DataFrame) -> DataFrame:
    """Cells of the selected columns: selected(qid, table_id, pos, col_name) gives ``qid, pos`` to each."""
    return cells.join(selected.select("qid", "table_id", "pos", "col_name"), ["table_id", "col_name"])

"""Text responses, one per row, turned into tables of votes, descriptions, answers and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions.text import json_value, let, trimmed

# Patterns and texts of the response formats.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
LIST = r"(?s)\[.*?\]"
ANSWER_LIST = r"(?is)answer:\s*(\[.*?\])"
WIDEST_LIST = r"(?s)\[.*\]"
# possessive throughout: Java's engine then loops where it would otherwise recurse once per character or name
QUOTED = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
QUOTED_LIST = rf"^\[\s*+(?:{QUOTED}\s*+(?:,\s*+{QUOTED}\s*+)*+,?+\s*+)?+\]$"
NAMED_TYPE = r'(?i)"?predicted_answer_entity"?\s*[:=]\s*"?(.*?)"?[\n,}]'
SKIPPED_STARTS = r"^(Question|Table)"
NOT_FOUND = "Answer not found in the table."
OTHER_TYPE = "Other"


def named_lines(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Lines ``name: rest`` of each response: ``keys..., line_no, line, name, rest``."""
    lines = responses.select(*keys, F.posexplode_outer(F.split(trimmed(F.col("text")), "\n")).alias("line_no", "line"))
    colon = F.instr("line", ":")
    return lines.where(colon > 0).select(
        *keys, "line_no", "line",
        trimmed(F.expr("substring(line, 1, instr(line, ':') - 1)")).alias("name"),
        trimmed(F.expr("substring(line, instr(line, ':') + 1)")).alias("rest"),
    )


def score_votes(responses: DataFrame) -> DataFrame:
    """Votes in responses(qid, iteration, text); the last valid line of a column wins."""
    score = F.when(F.col("rest").rlike(NUMBER), F.col("rest").try_cast("double"))
    return (
        named_lines(responses, ["qid", "iteration"])
        .where(~trimmed(F.col("line")).rlike(SKIPPED_STARTS))
        .withColumn("score", score)
        .where(F.col("score").between(0.0, 1.0))
        .groupBy("qid", "iteration", F.col("name").alias("col_name"))
        .agg(F.max_by("score", "line_no").alias("score"))
    )


def descriptions(responses: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Descriptions in responses(qid, text): ``qid, pos, col_name, description``.

    ``examples(qid, col_name, sample)`` is appended where the column exists.
    """
    found = (
        named_lines(responses, ["qid"])
        .groupBy("qid", F.col("name").alias("col_name"))
        .agg(F.min("line_no").alias("pos"), F.max_by("rest", "line_no").alias("description"))
    )
    if examples is None:
        return found
    return found.join(examples, ["qid", "col_name"], "left").withColumn(
        "description",
        F.when(F.col("sample").isNotNull(), F.concat("description", F.lit(" "), "sample")).otherwise(F.col("description")),
    ).drop("sample")


def parsed_list(text: Column) -> Column:
    """A JSON list as ARRAY<STRING>, null unless the whole text is one; null elements read ``None``."""
    return F.transform(json_value(text, "array<string>"), lambda x: F.coalesce(x, F.lit("None")))


def first_parsed(candidates: Column) -> Column:
    """First candidate that is a list; those after it are not parsed."""
    return F.aggregate(
        candidates, F.lit(None).cast("array<string>"), lambda found, c: F.coalesce(found, parsed_list(c))
    )


def answer_list(text: Column) -> Column:
    """The list a response answers with: a bracketed part, a list after ``Answer:``, or the last line
    that is a list from its first to its last bracket."""
    anywhere = first_parsed(F.regexp_extract_all(text, F.lit(LIST), 0))
    after_label = parsed_list(F.nullif(F.regexp_extract(text, ANSWER_LIST, 1), F.lit("")))
    lines = F.reverse(F.split(trimmed(text), "\n"))
    by_line = first_parsed(F.transform(lines, lambda s: F.nullif(F.regexp_substr(s, F.lit(WIDEST_LIST)), F.lit(""))))
    return F.coalesce(anywhere, after_label, by_line, F.array(F.lit(NOT_FOUND)))


def named_type(text: Column) -> Column:
    """Answer type named in a response, null when there is none."""
    return F.when(text.rlike(NAMED_TYPE), trimmed(F.regexp_extract(text, NAMED_TYPE, 1)))


def answers(responses: DataFrame) -> DataFrame:
    """Adds ``answers`` and ``answer_type`` to responses(qid, method, text)."""
    text = trimmed(F.col("text"))
    return responses.withColumn("answers", answer_list(text)).withColumn("answer_type", named_type(text))


def answer_types(responses: DataFrame) -> DataFrame:
    """Most confident type in responses(qid, text) that hold a JSON map of confidences, and the map as ``type_scores``.

    Equal confidences go to the first; anything else than a map of numbers is ``Other`` and has no scores.
    """
    entries = F.map_entries(json_value(F.col("text"), "map<string,double>"))
    usable = F.when(
        (F.size(F.col("entries")) > 0) & ~F.exists("entries", lambda x: x.value.isNull()), F.col("entries")
    )
    read = responses.withColumn("entries", entries).withColumn("entries", usable)
    top = F.array_max(F.transform("entries", lambda x: x.value))
    best = F.get(F.filter("entries", lambda x: x.value == top), F.lit(0)).getField("key")
    return read.withColumn("answer_type", F.coalesce(best, F.lit(OTHER_TYPE))).withColumn(
        "type_scores", F.map_from_entries("entries")
    ).drop("entries")


def essential_columns(responses: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns listed in responses(qid, text): ``qid, ess_ord, col_name``.

    ``columns(qid, col_ord, col_name)``. Names that do not exist are left out; a response that is not
    a list of strings makes every column essential.
    """
    text = trimmed(F.col("text"))
    body = F.regexp_replace(text, r",\s*\]$", "]")
    names = F.when(text.rlike(QUOTED_LIST), json_value(body, "array<string>", single_quotes=True))
    parsed = responses.select("qid", names.alias("names"))
    listed = (
        parsed.where(F.col("names").isNotNull())
        .select("qid", F.posexplode_outer("names").alias("ess_ord", "col_name"))
        .groupBy("qid", "col_name")
        .agg(F.min("ess_ord").alias("ess_ord"))
        .join(columns, ["qid", "col_name"], "left_semi")
        .select("qid", "ess_ord", "col_name")
    )
    rest = parsed.where(F.col("names").isNull()).join(columns, "qid").select(
        "qid", F.col("col_ord").alias("ess_ord"), "col_name"
    )
    return listed.unionByName(rest)

"""What a run knows of each question: its status, and one record of the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CLUSTERS = 3
OK, NO_TABLE, NO_SCORES, FEW_POINTS = "ok", "no_table", "no_scores", "few_points"


def question_status(questions: DataFrame, cells: DataFrame, scores: DataFrame) -> DataFrame:
    """``qid, status, reason`` of every question asked, also of those that end with no rows.

    ``failed``: its table is unknown or it has no column scores. A question whose columns are fewer than three distinct
    points goes on with as many clusters and says so.
    """
    tables = cells.select("table_id").distinct().withColumn("known", F.lit(True))
    point = F.struct(F.round("llm", 12), F.round("sim", 12))
    points = scores.groupBy("qid").agg(F.countDistinct(point).alias("points"))
    found = questions.select("qid", "table_id").join(tables, "table_id", "left").join(points, "qid", "left")
    reason = (
        F.when(F.col("known").isNull(), NO_TABLE)
        .when(F.col("points").isNull(), NO_SCORES)
        .when(F.col("points") < CLUSTERS, FEW_POINTS)
        .otherwise(OK)
    )
    return found.select(
        "qid", F.when(reason.isin(OK, FEW_POINTS), "ok").otherwise("failed").alias("status"), reason.alias("reason")
    )


def question_records(
    questions: DataFrame, status: DataFrame, clusters: DataFrame, vote: DataFrame, selected: DataFrame, types: DataFrame
) -> DataFrame:
    """One record per question: what the stages found for its columns and how the cluster was chosen.

    ``clusters`` as from ``cluster_columns``, ``vote`` from ``choose_cluster``, ``selected(qid, pos, col_name)``,
    ``types(qid, answer_type, type_scores)``. Lists are bounded by the width of the table; rows and text are written
    beside the records, in parts.
    """

    def listed(frame: DataFrame, name: str, *columns: str) -> DataFrame:
        return frame.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    columns = listed(clusters, "columns", "col_ord", "col_name", "llm", "sim", "cluster_id")
    centres = clusters.select("qid", "cluster_id", "cx", "cy").distinct()
    kept = listed(selected, "kept", "pos", "col_name")
    # JSON knows text keys only, so counts by cluster are a list
    counts = F.transform(F.map_entries("votes"), lambda e: F.struct(e.key.alias("cluster_id"), e.value.alias("votes")))
    vote = vote.withColumn("votes", counts)
    chosen = vote.select("qid", F.struct(*[c for c in vote.columns if c != "qid"]).alias("vote"))
    out = questions.select("qid", "table_id", "question").join(status, "qid", "left")
    for part in (columns, listed(centres, "centres", "cluster_id", "cx", "cy"), chosen, kept, types):
        out = out.join(part, "qid", "left")
    return out.withColumn("kept", F.transform("kept", lambda c: c.col_name))

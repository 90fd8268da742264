"""Choosing one column cluster per question: three methods and their vote.

``clusters`` is the output of ``cluster_columns``; ``questions(qid, question)``. All groups hold the
columns of one table. Scores are compared to 12 decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesieve.functions import questions as qf, vectors as vx

# Weights of the three methods.
COHESION, SEPARATION = 0.6, 0.4
RELEVANCE, DIVERSITY, DENSITY, SIZE = 0.4, 0.2, 0.2, 0.2
CONSISTENCY, STRENGTH, TYPE = 0.4, 0.4, 0.2
HIGH_SCORE = 0.7
THRESHOLD_FLOOR = 0.3
EPSILON = 1e-8


def settled(score: Column) -> Column:
    return F.round(score, 12)


def mean_score() -> Column:
    return (F.col("llm") + F.col("sim")) / 2


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """Statistics of each cluster, with those of all other columns of the question beside them."""
    parts = F.split(F.lower("col_name"), "_")
    named = F.size(parts) > 1
    m = mean_score()
    own = clusters.groupBy("qid", "cluster_id").agg(
        F.count("*").alias("size"),
        F.min("col_ord").alias("first_ord"),
        F.sum("llm").alias("llm_sum"),
        F.sum("sim").alias("sim_sum"),
        F.stddev_pop("llm").alias("llm_std"),
        F.stddev_pop("sim").alias("sim_std"),
        F.avg(m).alias("mean"),
        F.stddev_pop(m).alias("mean_std"),
        F.avg(F.when(settled(m) > HIGH_SCORE, 1.0).otherwise(0.0)).alias("density"),
        F.size(F.collect_set(F.when(named, F.element_at(parts, 1)))).alias("prefixes"),
        F.size(F.collect_set(F.when(named, F.element_at(parts, -1)))).alias("suffixes"),
        F.max("cx").alias("cx"),
        F.max("cy").alias("cy"),
    )
    question = W.partitionBy("qid")
    for name in ("size", "llm_sum", "sim_sum"):
        own = own.withColumn(f"all_{name}", F.sum(name).over(question))
    return own


def cluster_quality(profile: DataFrame) -> DataFrame:
    """Add ``cohesion``, ``separation`` and ``quality``; a cluster without others is fully separate."""
    others = F.col("all_size") - F.col("size")

    def gap(name: str) -> Column:
        return F.abs(F.col(name) / F.col("size") - (F.col(f"all_{name}") - F.col(name)) / others)

    return (
        profile.withColumn("cohesion", 1 - (F.col("llm_std") + F.col("sim_std")) / 2)
        .withColumn("separation", F.when(others > 0, (gap("llm_sum") + gap("sim_sum")) / 2).otherwise(1.0))
        .withColumn("quality", F.col("cohesion") * COHESION + F.col("separation") * SEPARATION)
    )


def semantic_scores(profile: DataFrame) -> DataFrame:
    """Cosine of the question's mean score vector and the cluster centre, times quality."""
    x, y = F.col("all_llm_sum") / F.col("all_size"), F.col("all_sim_sum") / F.col("all_size")
    cx, cy = F.col("cx"), F.col("cy")
    likeness = vx.cosine(x * cx + y * cy, F.sqrt(x * x + y * y), F.sqrt(cx * cx + cy * cy))
    return (
        cluster_quality(profile)
        .withColumn("similarity", likeness)
        .withColumn("semantic", F.col("similarity") * F.col("quality"))
    )


def name_diversity() -> Column:
    """Share of different first and last parts among the column names of a cluster."""
    return F.least((F.col("prefixes") + F.col("suffixes")) / (2 * F.col("size") + EPSILON), F.lit(1.0))


def mcdm_scores(profile: DataFrame, questions: DataFrame) -> DataFrame:
    """Weighted mean of relevance, diversity, density and size match as ``mcdm``."""
    asked = questions.select("qid", qf.complexity(F.col("question")).alias("complexity"))
    return (
        profile.join(asked, "qid")
        .withColumn("diversity", name_diversity())
        .withColumn("size_match", qf.size_match(F.col("size"), F.col("complexity")))
        .withColumn(
            "mcdm",
            RELEVANCE * F.col("mean") + DIVERSITY * F.col("diversity")
            + DENSITY * F.col("density") + SIZE * F.col("size_match"),
        )
    )


def adaptive_scores(profile: DataFrame, questions: DataFrame) -> DataFrame:
    """Confidence of each cluster as ``adaptive`` and the question's ``threshold``."""
    asked = questions.select("qid", qf.question_type(F.col("question")).alias("kind"))
    confidence = (
        CONSISTENCY * (1 - F.col("mean_std") / (F.col("mean") + EPSILON))
        + STRENGTH * F.col("mean")
        + TYPE * qf.type_weight(F.col("kind"), F.col("size"))
    )
    question = W.partitionBy("qid")
    spread = F.avg("adaptive").over(question) - 0.5 * F.stddev_pop("adaptive").over(question)
    return (
        profile.join(asked, "qid")
        .withColumn("adaptive", confidence)
        .withColumn("threshold", F.greatest(spread, F.lit(THRESHOLD_FLOOR)))
        .withColumn("valid", settled(F.col("adaptive")) >= settled(F.col("threshold")))
    )


def pick(score: str, *before: Column, tie: str) -> Column:
    """Aggregate: cluster with the best score; ties go to the smallest ``tie``."""
    return F.max_by("cluster_id", F.struct(*before, settled(F.col(score)), -F.col(tie)))


def choose_semantic(profile: DataFrame) -> DataFrame:
    return semantic_scores(profile).groupBy("qid").agg(
        pick("semantic", tie="cluster_id").alias("choice"), F.max("semantic").alias("score")
    )


def choose_mcdm(profile: DataFrame, questions: DataFrame) -> DataFrame:
    return mcdm_scores(profile, questions).groupBy("qid").agg(
        pick("mcdm", tie="first_ord").alias("choice"), F.max("mcdm").alias("score")
    )


def choose_adaptive(profile: DataFrame, questions: DataFrame) -> DataFrame:
    return adaptive_scores(profile, questions).groupBy("qid").agg(
        pick("adaptive", F.col("valid"), tie="first_ord").alias("choice"),
        F.max("adaptive").alias("score"),
        F.max("threshold").alias("threshold"),
    )


def choose_cluster(clusters: DataFrame, questions: DataFrame) -> DataFrame:
    """Three choices, their best scores, the vote and the votes of each cluster, one row per question.

    Three different choices are decided by the method with the best score of its own.
    """
    scored = adaptive_scores(mcdm_scores(semantic_scores(cluster_profile(clusters)), questions), questions)
    chosen = scored.groupBy("qid").agg(
        pick("semantic", tie="cluster_id").alias("semantic_choice"),
        pick("mcdm", tie="first_ord").alias("mcdm_choice"),
        pick("adaptive", F.col("valid"), tie="first_ord").alias("adaptive_choice"),
        *[F.max(c).alias(f"{c}_score") for c in ("semantic", "mcdm", "adaptive")],
        F.max("threshold").alias("threshold"),
        F.sort_array(F.collect_set("cluster_id")).alias("cluster_ids"),
    )
    a, b, c = F.col("semantic_choice"), F.col("mcdm_choice"), F.col("adaptive_choice")
    sa, sb, sc = (settled(F.col(f"{m}_score")) for m in ("semantic", "mcdm", "adaptive"))
    split = F.when((sa >= sb) & (sa >= sc), a).when(sb >= sc, b).otherwise(c)
    majority = F.when((a == b) | (a == c), a).otherwise(b)
    votes = F.transform(
        "cluster_ids",
        lambda k: F.struct(k.alias("cluster_id"), F.size(F.filter(F.array(a, b, c), lambda v: v == k)).alias("votes")),
    )
    return chosen.withColumn(
        "selected", F.when((a != b) & (a != c) & (b != c), split).otherwise(majority)
    ).withColumn("votes", F.map_from_entries(votes)).drop("cluster_ids")

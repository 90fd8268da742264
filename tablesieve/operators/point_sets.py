"""3-means of point sets of any size: the points stay rows, only centres and sums travel.

The array form of ``clusters`` holds a question's points in one row, which is right for the columns of a table. Here a round
is a join of the points with the centres of their question, and sums per (question, centre), added up where the points
are. Sums are decimals, so they do not depend on the order of the rows, on lost tasks or on partitions. A
question whose centres stand still takes no part in later rounds. Starts, distances, ties and rounding are those of the array form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.operators.clusters import MOST_ROUNDS, cluster_columns, steady
from tablesieve.operators.selection import positions
from tablesieve.runtime import materialize

#: Points of a question that one array may hold.
ARRAY_POINTS = 10_000

COORDINATE = "decimal(28,15)"
#: Centres of a question: the first, middle and last of its points.
CENTRES = 3


def first_centres(points: DataFrame) -> DataFrame:
    """``qid, centres``: first, middle and last of a question's distinct points, ordered by the sum of their scores."""
    distinct = points.select(
        "qid", F.round(F.col("llm") + F.col("sim"), 12).alias("s"), F.round("llm", 12).alias("x"), F.round("sim", 12).alias("y")
    ).distinct()
    placed = positions(distinct, "qid", "s", "x", "y")
    sizes = placed.groupBy("qid").agg(F.count("*").alias("m"))
    places = F.array_distinct(F.array(F.lit(1).cast("long"), F.ceil(F.col("m") / 2), F.col("m")))
    wanted = sizes.select("qid", F.explode(F.transform(places, lambda p: p - 1)).alias("place"))
    chosen = placed.join(wanted, ["qid", "place"])
    listed = F.sort_array(F.collect_list(F.struct("place", "x", "y")))
    return chosen.groupBy("qid").agg(F.transform(listed, lambda c: F.struct(c.x.alias("x"), c.y.alias("y"))).alias("centres"))


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with the number ``k`` of their nearest centre and the ``centres`` of their question.

    As ``clusters.nearest``, with a column per centre in place of an array: it runs for every point in every round. There are
    at most ``CENTRES``; the distance to one that is missing is null and takes no part.
    """
    placed = points.join(centres, "qid")

    def distance(i: int) -> Column:
        dx, dy = F.get("centres", F.lit(i))["x"] - F.col("llm"), F.get("centres", F.lit(i))["y"] - F.col("sim")
        return steady(dx * dx + dy * dy, 9)

    names = [f"_d{i}" for i in range(CENTRES)]
    placed = placed.select("*", *[distance(i).alias(name) for i, name in enumerate(names)])
    placed = placed.withColumn("_least", F.least(*names))
    number = F.coalesce(*[F.when(F.col(name) == F.col("_least"), i) for i, name in enumerate(names)])
    return placed.withColumn("k", number).drop("_least", *names)


def next_centres(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``qid, centres, still`` after one round; a centre without points stays where it is."""
    placed = assigned(points, centres.select("qid", "centres"))
    x, y = F.col("llm").cast(COORDINATE), F.col("sim").cast(COORDINATE)
    sums = placed.groupBy("qid", "k").agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.count("*").alias("n"))

    def mean(total: str):
        return steady(F.col(total).cast("double") / F.col("n"), 12)

    moved = sums.groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct(mean("sx").alias("x"), mean("sy").alias("y"))))).alias("moved")
    )
    after = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("moved", i), c))
    # every question has points, so every one has sums
    return centres.select("qid", "centres").join(moved, "qid").select("qid", after.alias("centres"), (after == F.col("centres")).alias("still"))


def cluster_points(scores: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """As ``cluster_columns``, for questions with any number of points: the same labels and centres.

    ``scores`` is read in every round: pass a written table. Centres are written down after each, one row per question.
    """
    centres = materialize(first_centres(scores).withColumn("still", F.lit(False)), "centres")
    done = []
    for _ in range(most_rounds):
        centres = materialize(next_centres(scores, centres), "centres")
        done.append(centres.where("still"))
        centres = centres.where(~F.col("still"))
        if centres.isEmpty():
            break
    else:
        done.append(centres)
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    own = F.get("centres", F.col("k"))
    return assigned(scores, materialize(settled.select("qid", "centres"), "centres")).select(
        "qid", "col_ord", "col_name", "llm", "sim", F.col("k").alias("cluster_id"), own["x"].alias("cx"), own["y"].alias("cy")
    )


def cluster_any(scores: DataFrame, array_points: int = ARRAY_POINTS) -> DataFrame:
    """3-means of every question: as one array where that is small enough, else on rows. ``scores`` should be written."""
    sizes = scores.groupBy("qid").agg(F.count("*").alias("_points"))
    many = materialize(sizes.where(F.col("_points") > array_points).select("qid"), "large-sets")
    if many.isEmpty():
        return cluster_columns(scores)
    large = materialize(scores.join(many, "qid", "left_semi"), "large-points")
    small = scores.join(many, "qid", "left_anti")
    return cluster_columns(small).unionByName(cluster_points(large))

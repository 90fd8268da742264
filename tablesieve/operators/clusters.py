"""3-means of the two column scores, for all questions at once.

A question's group holds one row per column of its table, so it is bounded by the table's width.
Points are gathered per question and all rounds run inside one expression: one shuffle in total. A question's
rounds end when its centres no longer move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesieve.functions.text import let

# Fixed value: most rounds. Centres stand still long before: every round lowers the sum of squares.
MOST_ROUNDS = 300
RUN = 15
POINT = "array<struct<x:double,y:double>>"


def start_centres(points: Column) -> Column:
    """First, middle and last of the distinct points, ordered by the sum of their scores."""
    distinct = F.sort_array(
        F.array_distinct(
            F.transform(
                points,
                lambda p: F.struct(
                    F.round(p.x + p.y, 12).alias("s"), F.round(p.x, 12).alias("x"), F.round(p.y, 12).alias("y")
                ),
            )
        )
    )

    def pick(ordered: Column) -> Column:
        m = F.size(ordered)
        places = F.array_distinct(F.array(F.lit(1), F.ceil(m / 2).cast("int"), m))
        return F.transform(
            places, lambda i: F.struct(F.element_at(ordered, i).x.alias("x"), F.element_at(ordered, i).y.alias("y"))
        )

    return let(distinct, pick).cast(POINT)


def steady(value: Column, digits: int) -> Column:
    """``value`` to a number of decimals, so that the order of summation cannot change what follows."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def nearest(centres: Column, point: Column) -> Column:
    """Number of the nearest centre; equal distances go to the lowest."""
    distances = F.transform(
        centres, lambda c: steady((c.x - point.x) * (c.x - point.x) + (c.y - point.y) * (c.y - point.y), 9)
    )
    return let(distances, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def moved(centres: Column, points: Column) -> Column:
    """Centres after one round; a centre without points stays where it is."""

    def updated(placed: Column) -> Column:
        def centre(c: Column, number: Column) -> Column:
            def mean(members: Column) -> Column:
                def of(pick) -> Column:
                    total = F.aggregate(members, F.lit(0.0), lambda acc, p: acc + pick(p))
                    return steady(total / F.size(members), 12)

                return F.when(
                    F.size(members) > 0, F.struct(of(lambda p: p.x).alias("x"), of(lambda p: p.y).alias("y"))
                ).otherwise(F.struct(c.x.alias("x"), c.y.alias("y")))

            return let(F.filter(placed, lambda p: p.k == number), mean)

        return F.transform(centres, centre)

    placed = F.transform(
        points, lambda p: F.struct(nearest(centres, p).alias("k"), p.x.alias("x"), p.y.alias("y"))
    )
    return let(placed, updated).cast(POINT)


def settled_centres(points: Column, most_rounds: int = MOST_ROUNDS) -> Column:
    """Centres after as many rounds as they move in.

    The rounds are run in turns of ``RUN``: once a round has changed nothing, the state is handed on as it is, and what
    is left costs a look per turn.
    """

    def round_of(state: Column) -> Column:
        after = moved(state.centres, points)
        return F.when(state.still, state).otherwise(
            let(after, lambda c: F.struct(c.alias("centres"), (c == state.centres).alias("still")))
        )

    def turn(state: Column, length: int) -> Column:
        return F.when(state.still, state).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(length)), state, lambda acc, _: round_of(acc))
        )

    turns = -(-most_rounds // RUN)
    start = F.struct(start_centres(points).alias("centres"), F.lit(False).alias("still"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda acc, _: turn(acc, RUN)).centres


def cluster_columns(scores: DataFrame) -> DataFrame:
    """Add ``cluster_id, cx, cy`` to ``qid, col_ord, col_name, llm, sim``.

    A question with fewer than three distinct points gets that many clusters.
    """
    member = F.struct("col_ord", "col_name", F.col("llm").alias("x"), F.col("sim").alias("y"))
    grouped = scores.groupBy("qid").agg(F.sort_array(F.collect_list(member)).alias("points"))
    centres = settled_centres(F.col("points"))
    labelled = grouped.withColumn("centres", centres).select("qid", "centres", F.explode("points").alias("p"))
    labelled = labelled.withColumn("cluster_id", nearest(F.col("centres"), F.col("p")))
    own = F.get("centres", F.col("cluster_id"))
    return labelled.select(
        "qid", "p.col_ord", "p.col_name", F.col("p.x").alias("llm"), F.col("p.y").alias("sim"),
        "cluster_id", own.x.alias("cx"), own.y.alias("cy"),
    )


def centres(clusters: DataFrame) -> DataFrame:
    """Centre of each cluster that has columns."""
    return clusters.groupBy("qid", "cluster_id").agg(F.max("cx").alias("cx"), F.max("cy").alias("cy"))

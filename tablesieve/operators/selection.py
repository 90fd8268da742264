"""Places of rows within groups of any size, and the first rows of each group without sorting the rest.

Neither uses a window over a group's rows. Places come from one global sort and counts per (group, partition). The first
rows are found by looking for the key at which they end: each pass counts the rows of a range of keys in ``BINS`` bins, and
the bin in which the wanted number is reached is the next range. What is shuffled in a pass is one row per group and bin,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablesieve.runtime import materialize

BINS = 256
#: A range of so many rows, or of this share of the rows wanted, is not narrowed any more.
FEW_ROWS = 16
FEW_SHARE = 0.05

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def positions(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """Adds ``place``, the position of each row within its group from 0.

    One global sort gives every row a position; a group's rows may span any number of partitions, and only
    (group, partition) counts are combined to find where each run starts.
    """
    placed = materialize(
        rows.orderBy(group, *order)
        .withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_position", 33))
    )
    runs = placed.groupBy(group, "_part").agg(F.min("_position").alias("_first"), F.count("*").alias("_size"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(group, "_part", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.join(starts, [group, "_part"])
        .withColumn("place", F.col("_position") - F.col("_first") + F.col("_before"))
        .drop("_position", "_part", "_first", "_before")
    )


def fraction(value: Column, low: Column, high: Column, kind: str) -> Column:
    """How far below ``high`` a value lies, from 0 to 1; it never falls from one value to a smaller one."""
    if kind in ("float", "double"):
        by_size = (F.log(high) - F.log(value)) / (F.log(high) - F.log(low))
        # keys of very different size are told apart by their logarithms, else the largest would have all bins
        return F.when((low > 0) & (high > low * 2), by_size).otherwise((high - value) / (high - low))
    whole = [c.cast("decimal(20,0)") for c in (value, low, high)]
    return (whole[2] - whole[0]).cast("double") / (whole[2] - whole[1]).cast("double")


def ranges(rows: DataFrame, group: str, keys: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """For each group the range of keys in which its first rows end: ``group, wanted, need, size, low, high``.

    Rows above the range are among the first, and ``need`` of the ``size`` rows in it; the range holds all rows between its
    least and its greatest keys.
    """
    kinds = dict(rows.dtypes)
    # a key that is not a number is left to the sort at the end
    numbers = [k for k in keys if kinds[k] in NUMBERS]
    apart = {k: F.col(f"low.{k}") != F.col(f"high.{k}") for k in numbers}
    least = F.struct(*[F.min(k).alias(k) for k in keys]).alias("low")
    most = F.struct(*[F.max(k).alias(k) for k in keys]).alias("high")
    size = F.count("*").alias("size")

    def narrowable() -> Column:
        some = F.lit(False)
        first_other = next((i for i, k in enumerate(keys) if kinds[k] not in NUMBERS), len(keys))
        for k in keys[:first_other]:
            some = some | apart[k]
        many = F.col("size") > F.greatest(F.lit(FEW_ROWS), F.col("wanted") * FEW_SHARE)
        return many & (F.col("need") < F.col("size")) & some

    whole = rows.groupBy(group).agg(size, least, most)
    state = materialize(
        whole.select(group, wanted(F.col("size")).cast("long").alias("wanted"), wanted(F.col("size")).cast("long").alias("need"), "size", "low", "high"),
        "ranges",
    )
    while True:
        open_ = state.where(narrowable())
        if open_.isEmpty():
            return state
        key = F.struct(*keys)
        inside = rows.select(group, *keys).join(open_, group).where((key >= F.col("low")) & (key <= F.col("high")))
        place = F.coalesce(*[F.when(apart[k], fraction(F.col(k), F.col(f"low.{k}"), F.col(f"high.{k}"), kinds[k])) for k in numbers])
        binned = inside.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(place * BINS)).cast("int"))
        counts = binned.groupBy(group, "wanted", "need", "bin").agg(size, least, most)
        upper = W.partitionBy(group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        summed = counts.withColumn("above", F.coalesce(F.sum("size").over(upper), F.lit(0)))
        ends = (F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("size"))
        narrowed = summed.where(ends).select(group, "wanted", (F.col("need") - F.col("above")).alias("need"), "size", "low", "high")
        state = materialize(state.where(~narrowable()).unionByName(narrowed), "ranges")


def select_best(rows: DataFrame, group: str, keys: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The first rows of each group by ``keys``, greatest first, with their ``place`` from 0.

    ``wanted`` gives their number from the group's size. Keys must not be null and should tell all rows of a group apart. Only
    rows of the range in which the first rows end, and those above it, are sorted. ``rows`` is read once for each
    pass: pass a written table or expressions over one.
    """
    ends = ranges(rows, group, keys, wanted).select(group, F.col("wanted").alias("_wanted"), F.col("low").alias("_low"))
    above = rows.join(ends, group).where(F.struct(*keys) >= F.col("_low")).drop("_low")
    placed = positions(above, group, *[F.desc(k) for k in keys])
    return placed.where(F.col("place") < F.col("_wanted")).drop("_wanted")

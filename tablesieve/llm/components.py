"""Connected components of links between 64-bit ids, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesieve.runtime import materialize


def flattened(hooks: DataFrame) -> DataFrame:
    """``node, hook, root``: where the hooks(node, hook) of a node end. Every pass halves the way; a star needs one."""
    trees = materialize(hooks.select("node", "hook", F.col("hook").alias("root")), "trees")
    while True:
        there = trees.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = materialize(trees.join(there, "root", "left").select("node", "hook", F.coalesce("beyond", "root").alias("root"), "beyond"), "trees")
        trees = moved.select("node", "hook", "root")
        if moved.where(F.col("beyond").isNotNull()).isEmpty():
            return trees


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of links(a, b): the smallest node that links lead to.

    In each round a node hooks to its smallest neighbour, if that is smaller, which makes trees; links are carried over to the
    trees' roots, and those within a tree are gone. So the first round reads all links, once, and later ones what is left
    between trees. Every round takes nodes away; each is written down, which cuts the lineage. A node with many links is an
    ordinary row of the aggregate. No links give no nodes; a node linked to itself alone is its own root.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    apart, rounds = edges.where("a <> b"), []
    while not apart.isEmpty():
        trees = flattened(apart.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hook")))
        rounds.append(trees.select("node", F.col("root").alias("above")))
        # a link that is its node's hook lies within a tree
        left = apart.join(trees.withColumnRenamed("node", "a"), "a").where(F.col("b") != F.col("hook")).select("root", "b").distinct()
        ends = trees.select(F.col("node").alias("b"), F.col("root").alias("end"))
        left = left.join(ends, "b", "left").select("root", F.coalesce("end", "b").alias("end")).where(F.col("root") != F.col("end"))
        apart = materialize(left.select(F.greatest("root", "end").alias("a"), F.least("root", "end").alias("b")).distinct(), "apart")
    roots = nodes.select("node", F.col("node").alias("root"))
    for trees in rounds:
        roots = roots.join(trees.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return materialize(roots, "roots")

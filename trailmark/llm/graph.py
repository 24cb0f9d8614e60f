"""Connected components of a graph of links, on DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of any direction to (node, comp): comp is the smallest node that links reach.

    In each round every root hooks to its smallest neighbour, if that is smaller; the trees are flattened
    by doubling; and links are drawn between the trees' roots, until none is left. A root that neither
    hooked nor was hooked to has a neighbour that hooked to a smaller one, so it hooks in the next round:
    two rounds halve the roots that have links at least, and a round takes doublings in the logarithm of
    the trees' depth. Labels get smaller and links fewer each time, so it ends without a limit.
    """
    made = Scratch(edges.sparkSession)
    left = made.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = None
    while True:
        roots = _flat(made, left.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
        if labels is None:
            labels = made.table(roots, "labels")
        else:
            beyond = roots.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
            labels = made.table(labels.join(beyond, "comp", "left").select("node", F.coalesce("beyond", "comp").alias("comp")), "labels")
        ends = left.join(roots.select(F.col("node").alias("a"), F.col("comp").alias("a2")), "a").join(roots.select(F.col("node").alias("b"), F.col("comp").alias("b2")), "b")
        left = made.table(ends.filter("a2 != b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "links")
        if not left.limit(1).count():
            made.drop("links", "trees")
            return labels


def _flat(made: Scratch, trees: DataFrame) -> DataFrame:
    """(node, comp: a node that isn't larger) with the root of each node's tree as comp."""
    trees = made.table(trees, "trees")
    while True:
        jump = trees.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        step = made.table(trees.join(jump, "comp").select("node", F.col("comp").alias("was"), F.col("beyond").alias("comp")), "trees")
        trees = step.select("node", "comp")
        if not step.filter("was != comp").limit(1).count():
            return trees

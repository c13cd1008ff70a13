"""Connected components of a link table that stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.session import staged


def connected(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of `links` (a, b). No links give no rows.

    Every node has a parent that is no larger than itself. A round looks at the grandparents of all neighbours: the
    smallest is hooked onto the node and onto the node's parent, so that whole trees join at once whatever the order of
    ids along a chain; then parents are replaced by grandparents. Parents only fall and something falls in every round
    but the last, so it ends; random orders of long chains take a number of rounds that grows with the logarithm of
    their length. Parents are written to the shared folder after each round. A node with many links is one partial
    aggregate per task.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent"))
    state = staged(_with_grandparents(staged(first, "parents")), "parents")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        seen = staged(state.join(near, "node"), "near")
        hooks = seen.groupBy(F.col("parent").alias("node")).agg(F.min("near").alias("hook"))
        moved = seen.join(hooks, "node", "left").select("node", F.least("parent", "grand", "near", F.coalesce("hook", "near")).alias("parent"), F.col("parent").alias("was"))
        moved = staged(moved, "parents")
        state = staged(_with_grandparents(moved), "parents")
        if state.where("parent <> was OR grand <> parent").isEmpty():
            return state.select("node", F.col("parent").alias("label"))


def _with_grandparents(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(above, "parent")

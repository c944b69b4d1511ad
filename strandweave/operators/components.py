"""Connected components by alternating large and small stars, DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_or_not, written

#: Edges that one task of a round's result writes.
TASK_EDGES = 200_000


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(a, b) for every node ``a`` of the edges (u, v): ``b`` is the least node of its component;
    least nodes themselves are left out.

    Each round joins every node with the least of its neighbours, which ends in stars after a
    logarithmic number of rounds whatever the shape. Minima are combined before the shuffle and
    written, so that the join of a hub's edges with its one minimum is a broadcast, or a join whose
    hub side adaptive execution can split. Nulls: an edge with a null end joins nothing. Repeated
    edges and loops change nothing; no edges, no rows. ``files`` bounds the files of the edges as
    they are first written, where the caller knows how few they are.
    """
    first = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("u <> v").distinct()
    stars = written(first if files is None else first.coalesce(files))
    tasks = max(1, -(-stars.count() // TASK_EDGES))

    def least(pairs: DataFrame) -> DataFrame:
        return small_or_not(written(pairs.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)))

    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        lowest = least(large)
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks))
        ends = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("held"))
        held = stars.groupBy(F.col("b").alias("a")).agg(F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("held"))
        if ends.unionByName(held).groupBy("a").agg(F.sum("n").alias("n"), F.max("held").alias("held")).where("n > 1 or n = 1 and held = 1").isEmpty():
            return stars


def component_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for a table of nodes; a node without edges is its own component."""
    labels = components(edges).select(F.col("a").alias("node"), "b")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("b", "node").alias("component"))

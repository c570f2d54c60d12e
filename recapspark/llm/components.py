"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.operators.storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: for every node of ``edges(a, b)`` the smallest node it reaches.

    Each round maps a node to the smallest node next to it, follows that pointer once
    more, and replaces the edges by the edges between what their ends became. Every node
    that has a smaller neighbour moves, so at least half of the remaining nodes vanish
    per round. Minima are combined before the shuffle, and the joins are plain shuffle
    joins of stored tables, which adaptive execution splits where one node is hot.
    The tables of a round have files by the number of edges, so late rounds write few.
    Nodes without edges are not listed; loops and repeated edges are harmless.
    """
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter(F.col("a") < F.col("b"))
        .distinct(),
        "edges",
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reached = nodes.withColumn("root", F.col("node"))
    while n := edges.count():
        ends = edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("node"), F.col("b").alias("near")),
                    F.struct(F.col("b").alias("node"), F.col("a").alias("near")),
                )
            ).alias("e")
        ).select("e.*")
        step = stored(
            ends.groupBy("node").agg(F.least("node", F.min("near")).alias("up")),
            "step", 2 * n,
        )
        above = step.select(F.col("node").alias("_via"), F.col("up").alias("top"))
        step = stored(
            step.join(above, F.col("up") == F.col("_via")).select("node", "top"),
            "step", 2 * n,
        )
        to_a = step.select(F.col("node").alias("a"), F.col("top").alias("_a"))
        to_b = step.select(F.col("node").alias("b"), F.col("top").alias("_b"))
        edges = stored(
            edges.join(to_a, "a")
            .join(to_b, "b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .filter(F.col("a") < F.col("b"))
            .distinct(),
            "edges", n,
        )
        moved = step.select(F.col("node").alias("root"), "top")
        reached = reached.join(moved, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
    return reached

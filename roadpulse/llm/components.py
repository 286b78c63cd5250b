"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import cut, dealt

ROUNDS_OF_ORDER = 4


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of `edges` (a, b) one node of its component, the same for all of them.

    Contraction: each round every node points to the neighbour (or itself) that a hash puts first, then to where that
    one points, and edges are redrawn between the nodes pointed to. The hash stays for ROUNDS_OF_ORDER rounds, in which the leaves
    of a star all reach one node at once; then it changes, so chains in any order shrink by a constant part on
    average, and rounds grow with the logarithm of a component. Minima are aggregated before the shuffle; no
    neighbourhood is collected, and no table goes to the driver. Rounds are cut by reliable checkpoints.
    Loops and repeated edges change nothing; an empty table gives an empty one.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    roots = None
    round_ = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_ // ROUNDS_OF_ORDER)).alias("h"), F.col(c).alias("node"))  # noqa: E731,B023
        points = cut(
            both.groupBy("a").agg(F.min(rank("b")).alias("low"))
            .select(F.col("a").alias("node"), F.least("low", rank("a"))["node"].alias("to"))
        )
        to = lambda c: dealt(points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")))  # noqa: E731,B023
        points = cut(points.join(to("to"), "to").select("node", F.col("to_to").alias("to")))
        edges = cut(
            edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        )
        if roots is None:
            roots = points.select("node", F.col("to").alias("root"))
        else:
            moved = roots.join(to("root"), "root", "left")
            roots = cut(moved.select("node", F.coalesce("root_to", "root").alias("root")))
        round_ += 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wovengraph.llm.common import checkpoint

#: Doublings of the pointers in a round.
JUMPS = 3


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node reachable.

    Each round every node with a lesser neighbour points to the least one, pointers are doubled
    JUMPS times (which follows chains of up to 2^JUMPS to their ends; longer ones go on in the
    next round) and the links are rewritten between the nodes pointed to.  Links within a node
    are gone, so the rounds get smaller fast, and the largest node of each component goes in
    each, so they end.  A round is two jobs: the number of links left is observed as they are
    written.  Only aggregates with map-side combination and equi joins are used: a node with a third
    of all links is a skewed join that Spark splits.  Self links and repeated links are
    harmless; links with a null end are left out."""
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    first = checkpoint(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    labels = first.select(F.col("x").alias("node")).union(first.select("y")).distinct().withColumn("root", F.col("node"))
    edges, left = _written(first.where("x < y"))
    while left:
        moves = edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("to"))
        for _ in range(JUMPS):
            moves = moves.join(moves.select(F.col("node").alias("to"), F.col("to").alias("top")), "to", "left").select("node", F.coalesce("top", "to").alias("to"))
        moves = checkpoint(moves)
        moved = edges.join(moves.select(F.col("node").alias("x"), F.col("to").alias("a")), "x", "left").join(moves.select(F.col("node").alias("y"), F.col("to").alias("b")), "y")
        moved = moved.select(F.coalesce("a", "x").alias("x"), F.col("b").alias("y")).where("x <> y")
        edges, left = _written(moved.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        labels = labels.join(moves.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpoint(labels)


def _written(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges, checkpointed, and their number."""
    seen = Observation()
    edges = checkpoint(edges.observe(seen, F.count(F.lit(1)).alias("n")))
    return edges, seen.get["n"]

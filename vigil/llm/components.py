"""Connected components of an edge table by alternating large-star and small-star
rounds: each round is joins and partial aggregates, no node's edges meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("nb")).union(
        edges.select(F.col("v").alias("n"), F.col("u").alias("nb")))
    least = both.groupBy("n").agg(F.min("nb").alias("m")).select("n", F.least("n", "m").alias("m"))
    return (both.join(least, "n").where(F.col("nb") > F.col("n"))
            .select(F.col("nb").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(node, root)`` for every node with an edge
    to another node except the roots themselves; root is the smallest node reachable.
    Self edges and repeated edges are harmless; no edges give no rows."""
    state = materialize(edges.where(F.col("u") != F.col("v"))
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or mark["n"] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (mark["n"], mark["h"])
        state = materialize(_small_star(_large_star(state)), "edges")

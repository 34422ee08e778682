"""Connected components by random contraction, with joins and map-side combined aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); the component is its smallest node.

    Each round every node moves to the neighbour (or itself) that is first in a random order of that
    round, edges are redrawn between the new ends and made distinct, and loops go. The expected number of
    edges falls by a constant factor, so the rounds are logarithmic, whatever the shape; a node with
    most edges costs one partial row per task. Every round's tables are stored in the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), f"{name}-edges")
    moves, left = [], edges
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64(F.col("b"), F.lit(len(moves))).alias("h"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(len(moves))).alias("h"), F.col("a").alias("to"))
        move = stored(both.groupBy("a").agg(first.alias("m"))
                      .select(F.col("a").alias("node"), F.least("m", own)["to"].alias("to")), f"{name}-moves")
        moves.append(move)
        left = stored(
            left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{name}-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moves[0]
    for move in moves[1:]:
        at = at.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"))
    at = stored(at, f"{name}-ends")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")

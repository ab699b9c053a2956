"""Bounded graph traversals as frontier loops: one join, one distinct and one anti-join a hop.

Edges are often resolved from raw references; where several hops read them, they are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.plans.scratch import materialize, shuffled

MAX_DEPTH = 6


def clamp(depth: int, most: int = MAX_DEPTH) -> int:
    return max(1, min(int(depth), most))


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hop): nodes that a walk of 1 to ``depth`` edges reaches from any start node, at their first hop.

    ``edges``: (src, dst); ``start``: (id). A start node is in the result if a walk leads back to it.
    """
    depth = clamp(depth)
    steps = edges.select("src", "dst").distinct()
    if depth > 1:
        steps = materialize(steps)
    seen = None
    frontier = start.select("id").distinct()
    for hop in range(1, depth + 1):
        reached = frontier.join(shuffled(steps), frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        if seen is not None:
            reached = reached.join(shuffled(seen), "id", "left_anti")
        reached = reached.withColumn("hop", F.lit(hop))
        if depth > 1:
            reached = materialize(reached)
        seen = reached if seen is None else seen.unionByName(reached)
        if hop < depth and reached.isEmpty():
            break
        frontier = reached.select("id")
    return seen


def _onward(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, parent): what is one edge further, with the smallest node of the frontier that leads there."""
    return frontier.join(shuffled(steps), frontier["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def _new(reached: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The part of ``reached`` that none of the levels after the first has."""
    for level in levels[1:]:
        reached = reached.join(shuffled(level).select("id"), "id", "left_anti")
    return materialize(reached)


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """One row (ids array, hops) with a shortest path from any start to any end node, or none.

    Frontiers grow from both ends, the smaller one first, until they meet; each goes half of the way, so neither holds the
    nodes of the last levels, which are most of a graph. From where they meet, forward levels go on within the backward ones alone.
    Each node keeps its smallest predecessor; of the end nodes that are nearest, the smallest counts. From a node to
    itself: its shortest cycle.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select("src", "dst").distinct())
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead, behind = [materialize(start.select("id").distinct())], [materialize(end.select("id").distinct())]
    sizes = [ahead[0].count(), behind[0].count()]
    met = None
    for _ in range(clamp(depth)):
        if not min(sizes):
            break
        if sizes[0] <= sizes[1]:
            ahead.append(_new(_onward(ahead[-1].select("id"), steps), ahead))
            sizes[0] = ahead[-1].count()
        else:
            behind.append(_new(_onward(behind[-1].select("id"), back).select("id"), behind))
            sizes[1] = behind[-1].count()
        meeting = ahead[-1].join(behind[-1].select("id"), "id", "left_semi")
        if not meeting.isEmpty():
            met = materialize(meeting)
            break
    if met is None:
        return spark.createDataFrame([], "ids array<string>, hops int")
    levels = [*ahead[1:-1], met] if len(ahead) > 1 else []
    frontier = met.select("id")
    for level in reversed(behind[:-1]):
        levels.append(materialize(_onward(frontier, steps).join(level.select("id"), "id", "left_semi")))
        frontier = levels[-1].select("id")
    ids = [frontier.agg(F.min("id")).first()[0]]
    for level in reversed(levels):  # at most six look-ups
        ids.append(level.where(F.col("id") == ids[-1]).first()["parent"])
    return spark.createDataFrame([(ids[::-1], len(ids) - 1)], "ids array<string>, hops int")

"""PageRank with a fixed number of iterations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.plans.scratch import bucketed, materialize, shuffled


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank): parallel edges count, edges with an unknown end don't, dangling mass is spread evenly.

    Ranks start even and sum to 1. An iteration is linear in the ranks but for the dangling mass, which is the same
    for all nodes. So only the even vector is carried along the links, time and again: one join, with links that
    are written once in the order of their sources, and one aggregation a step. Ranks are a weighted sum of
    these vectors; the weights follow from the vectors' dangling masses, a number each.
    """
    spark = nodes.sparkSession
    nodes = shuffled(materialize(nodes.select("id").distinct()))
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "id string, rank double")
    known = edges.select("src", "dst").join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = materialize(known.groupBy("src", "dst").agg(F.count("*").alias("times")))
    degrees = pairs.groupBy("src").agg(F.sum("times").alias("degree"))
    links = bucketed(shuffled(pairs).join(degrees, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share")), "src")
    carried = nodes.select("id", F.lit(1.0 / n).alias("value"))
    vectors, sent = [], []
    for _ in range(iterations):
        got = links.join(shuffled(carried).withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("share")).alias("value"))
        carried = materialize(got)
        vectors.append(carried)
        sent.append(carried.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0])  # all but what dangling nodes had
    total = [1.0, *sent]
    weights = [1.0]  # of the even vector and what it became, in the ranks of this step
    for _ in range(iterations):
        mass = sum(w * (total[k] - total[k + 1]) for k, w in enumerate(weights))
        weights = [1 - damping + damping * mass, *(damping * w for w in weights)]
    parts = [v.select("id", (F.col("value") * F.lit(w)).alias("rank")) for v, w in zip(vectors, weights[1:])]
    start = nodes.select("id", F.lit(weights[0] / n).alias("rank"))
    return reduce(DataFrame.unionByName, parts, start).groupBy("id").agg(F.sum("rank").alias("rank"))


def symbol_ranks(symbols: DataFrame, *edges: DataFrame) -> DataFrame:
    """Ranks over the multiset union of calls, uses and inheritance."""
    return pagerank(symbols.select("id"), reduce(DataFrame.unionByName, [e.select("src", "dst") for e in edges]))

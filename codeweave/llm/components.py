"""Connected components over an edge table of any size, by alternating large and small stars, and one row of each.

Each round is two aggregations and two joins on long keys; a vertex with very many neighbours is
combined before the shuffle and split by the skew join. Rounds are written to the shared folder, so
a lost executor costs one round at most; the driver sees one number a round. What edges were found before
enters as its stars, and edges that are stars already cost no round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import discard, fresh_names, materialize


def _unsettled(edges: DataFrame) -> int:
    """Vertices that have two edges downwards, or edges both ways: none where every component is a star around its root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    counted = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counted.agg(F.count_if(F.expr("down > 1 OR (down = 1 AND up = 1)"))).first()[0]


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u long, v long) but the roots; root is the smallest vertex reachable.

    ``known``: what this gave for edges before; they count as if they were among ``edges``.
    """
    spark = edges.sparkSession
    edges = edges.select("u", "v") if known is None else edges.select("u", "v").unionByName(known.select("u", F.col("root").alias("v")))
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unsettled(now):
        # large star: all larger neighbours of a vertex move to its smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct())
        discard(spark, now)
        now = after
    return now.select("u", F.col("v").alias("root"))


def text_digest(text: Column) -> Column:
    """Tells the rows of one id apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def one_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each component.

    ``rows``: doc_id, digest (:func:`text_digest`) and node of every row; ``roots``: u and root of nodes that aren't
    their own root. The row with the smallest doc_id stays, a null id only if there is no other; of rows with
    the same id the one with the smallest digest; of equal rows one.
    """
    rooted = rows.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    crowded = materialize(rooted.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best"))
    grouped = materialize(rooted.join(crowded, "root").groupBy("doc_id", "digest", "best").agg(F.count("*").alias("times")))
    discard(docs.sparkSession, crowded)
    id_, other, own = fresh_names(docs, 3)
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    gone = grouped.where(~stays).select(F.col("doc_id").alias(id_), F.col("digest").alias(other))
    twice = grouped.where(stays & (F.col("times") > 1)).select(F.col("doc_id").alias(id_), F.col("digest").alias(other))
    keyed = docs.withColumn(own, text_digest(F.col("text")))

    def same(keys: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(keys[id_]) & (keyed[own] == keys[other])

    if twice.isEmpty():
        return keyed.join(gone, same(gone), "left_anti").select(*docs.columns)
    either = gone.unionByName(twice)
    once = keyed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", own])
    return keyed.join(either, same(either), "left_anti").unionByName(once).select(*docs.columns)

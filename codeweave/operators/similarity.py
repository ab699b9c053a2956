"""Exact cosine search over normalised vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(size == 0, F.lit(1.0)).otherwise(size)


def normalised(vectors: DataFrame) -> DataFrame:
    """Rows with ``embedding`` scaled to length 1; zero vectors stay."""
    size = norm(F.col("embedding"))
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") / size).cast("float")))


def nearest(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(id, score) of the ``limit`` rows with the largest cosine to ``query``; vectors of another length take no part."""
    size = math.sqrt(sum(float(x) * float(x) for x in query)) or 1.0
    literal = F.array(*[F.lit(float(x) / size) for x in query])
    dot = F.aggregate(F.zip_with("embedding", literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = vectors.where(F.size("embedding") == len(query)).select("id", (dot / norm(F.col("embedding"))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)

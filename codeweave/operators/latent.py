"""Vectors learned from the indexed texts themselves: a truncated SVD of how much more often a word is in a text than by chance.

The matrix has a row for each text and a column for each word, with positive pointwise mutual information,
max(0, ln(n / (R s))): n times in a text of R words, a word that is a share s of all words. Words that come with the
same words get near vectors, so a query finds names that say it in other words, in the words of this code base.

The SVD is randomised (Halko, Martinsson, Tropp 2011): the column space is found by multiplying a random matrix with A and
A transposed a few times, each product a join and an aggregation; between them columns are made orthonormal by the Cholesky factor
of their Gram matrix. The driver sees matrices of rank x rank numbers only, whatever the number of texts and words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.operators.similarity import norm
from codeweave.plans.scratch import discard, materialize

RANK = 192
#: Sub-words of identifiers and prose.
_PART = r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[\p{L}&&[^A-Za-z]]+)"


def words_of(text: Column) -> Column:
    """Lower-cased sub-words in order, each also by its first four letters, which kindred words share."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PART), F.lit(1)), lambda w: F.lower(w))
    return F.concat(words, F.transform(F.filter(words, lambda w: F.char_length(w) > 4), lambda w: F.concat(F.substring(w, 1, 4), F.lit("*"))))


def counted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, total): how often each token is in each text, and how many tokens that has."""
    words = texts.select(F.col(key), words_of(F.col(text)).alias("words"))
    return words.select(key, F.size("words").alias("total"), F.explode("words").alias("token")).groupBy(key, "total", "token").agg(F.count("*").alias("n"))


def _ppmi(n: Column, total: Column, share: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(n / (total * share)))


def _times(entries: DataFrame, by: str, vectors: DataFrame, to: str, width: int) -> DataFrame:
    """(to, v): the products of the matrix's rows, or columns, with ``vectors`` (by, v)."""
    joined = entries.join(vectors, by)
    sums = joined.groupBy(to).agg(*(F.sum(F.col("x") * F.col("v")[i]).alias(f"s{i}") for i in range(width)))
    return sums.select(to, F.array(*(f"s{i}" for i in range(width))).alias("v"))


def _random(tokens: DataFrame, width: int) -> DataFrame:
    """(token, v): normal numbers that follow from the token, so they are the same on every run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.random.default_rng(zlib.crc32(t.encode())).standard_normal(width).tolist() for t in b.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(rows, pa.list_(pa.float64()))], names=["token", "v"])

    return tokens.select("token").mapInArrow(work, "token string, v array<double>")


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The products of all columns with each other, added up by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            rows = np.asarray(b.column("v").flatten(), float).reshape(-1, width)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    parts = vectors.select("v").mapInArrow(work, "g array<double>").select(F.posexplode("g"))
    out = np.zeros(width * width)
    for r in parts.groupBy("pos").agg(F.sum("col").alias("s")).collect():  # width x width numbers
        out[r["pos"]] = r["s"]
    return out.reshape(width, width)


def _turned(vectors: DataFrame, by: str, matrix: np.ndarray) -> DataFrame:
    """``vectors`` times a small matrix."""
    schema = vectors.select(by, "v").schema
    width = len(matrix)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.asarray(b.column("v").flatten(), float).reshape(-1, width) @ matrix
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(by), pa.ListArray.from_arrays(offsets, rows.ravel())], names=[by, "v"])

    return vectors.select(by, "v").mapInArrow(work, schema)


def _orthonormal(vectors: DataFrame, by: str, width: int) -> DataFrame:
    gram = _gram(vectors, width)
    values, basis = np.linalg.eigh(gram)
    kept = values > values.max() * 1e-10 if len(values) else values > 0  # fewer words than columns
    return _turned(vectors, by, np.where(kept, basis / np.sqrt(np.where(kept, values, 1.0)), 0.0))


def matrix(seen: DataFrame, key: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(key, token, x) of counted texts, positive entries alone, and (token, share): tokens in ``least`` texts or more."""
    known = seen.groupBy("token").agg(F.sum("n").alias("times"), F.count("*").alias("texts")).where(F.col("texts") >= least)
    shares = materialize(known.crossJoin(F.broadcast(seen.agg(F.sum("n").alias("all")))).select("token", (F.col("times") / F.col("all")).alias("share")))  # one row
    return seen.join(shares, "token").select(key, "token", _ppmi(F.col("n"), F.col("total"), F.col("share")).alias("x")).where("x > 0"), shares


def fit(texts: DataFrame, key: str, text: str, rank: int = RANK, more: int = 8, rounds: int = 2, least: int = 2, damp: float = 0.5) -> DataFrame:
    """(token, share, vector) of every token in ``least`` texts or more.

    ``vector``: the token's right singular vectors, each divided by its singular value to the power of ``damp``. Empty where no token is
    in so many texts. ``more`` columns beyond ``rank`` and ``rounds`` products make the leading ones exact.
    """
    spark, width = texts.sparkSession, rank + more
    seen = materialize(counted(texts, key, text))
    found, shares = matrix(seen, key, least)
    entries = materialize(found)
    columns = _random(shares, width)
    for _ in range(rounds):
        rows = materialize(_times(entries, "token", columns, key, width))
        products = materialize(_times(entries, key, rows, "token", width))
        columns = materialize(_orthonormal(products, "token", width))
        for used in (rows, products):
            discard(spark, used)
    rows = materialize(_times(entries, "token", columns, key, width))
    values, basis = np.linalg.eigh(_gram(rows, width))
    leading = np.argsort(-values)[:rank]
    sizes = np.sqrt(np.maximum(values[leading], 0.0))
    scale = np.where(sizes > sizes.max() * 1e-6, np.where(sizes > 0, sizes, 1.0) ** -damp, 0.0) if len(sizes) else sizes
    out = materialize(_turned(columns, "token", basis[:, leading] * scale).join(shares, "token").select("token", "share", F.col("v").alias("vector")))
    for used in (seen, shares, entries, columns, rows):
        discard(spark, used)
    return out


def encode(texts: DataFrame, model: DataFrame, key: str, text: str, rank: int = RANK) -> DataFrame:
    """(key, embedding) of length 1 for every text; zeros for one without a known token."""
    entries = counted(texts, key, text).join(model.select("token", "share", F.col("vector").alias("v")), "token")
    found = _times(entries.withColumn("x", _ppmi(F.col("n"), F.col("total"), F.col("share"))), "token", model.select("token"), key, rank)
    all_ = texts.select(key).distinct().join(found.withColumnRenamed("v", "embedding"), key, "left")
    whole = all_.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), rank)))
    return whole.select(key, F.transform("embedding", lambda x: (x / norm(F.col("embedding"))).cast("float")).alias("embedding"))


def encode_query(model: DataFrame, text: str, rank: int = RANK) -> list[float]:
    """The vector of one text; reads the rows of its own tokens."""
    one = model.sparkSession.createDataFrame([(0, text)], "id int, text string")
    tokens = [r["token"] for r in counted(one, "id", "text").select("token").collect()]  # as many as the query has
    return encode(one, model.where(F.col("token").isin(tokens)), "id", "text", rank).first()["embedding"]

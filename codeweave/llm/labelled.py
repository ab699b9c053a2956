"""Bounded training samples and the one-variable calibration that the scoring operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents that aren't held out, the same ones on every run.

    The choice is by a hash of the id, on the narrow table of labels; an id with several labels takes
    the largest, an id that several documents have its smallest text, so there is one row an id. The sample,
    not the corpus, is what gets broadcast: its size is bounded by ``most``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def within_bytes(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Of written :func:`training_rows`, as many as have ``most_bytes`` bytes of text together, in the order of the sample.

    A text that is longer by itself doesn't count and isn't taken. The driver sees three numbers a row.
    """
    order, size = F.xxhash64("doc_id"), F.octet_length("text")
    rows = rows.where(size <= most_bytes)
    seen = rows.select(order.alias("order"), "doc_id", size.cast("long").alias("size")).toArrow()
    by = seen.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    fit = int((np.cumsum(by.column("size").to_numpy()) <= most_bytes).sum())
    if fit == by.num_rows:
        return rows
    beyond = by.slice(fit, 1).to_pylist()[0]
    return rows.where((order < beyond["order"]) | ((order == beyond["order"]) & (F.col("doc_id") < beyond["doc_id"])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (bias first) of a ridge-penalised logistic regression on the columns of ``x``, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w)) * max(1, len(y))
    penalty[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))

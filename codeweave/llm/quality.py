"""Quality classifier by compression: two zstandard dictionaries, one from good and one from bad text.

A text is cut into pieces of about ``piece`` bytes, all of it; every piece is compressed with either
dictionary. The difference of the compressed sizes, divided by the size of the text, becomes a
probability by logistic calibration on rows that the dictionaries have not seen.

Training takes a bounded sample: at most ``most`` labelled documents, chosen by a hash of the id, of which
those with an even hash make the dictionaries and the others the calibration. A class's dictionary is
trained on at most ``pieces`` pieces of its texts, chosen by a hash from all pieces of all of them, so one
very long text is no more than its pieces. Scoring covers every row and whole texts; only the text is an input.

Defined cases: null and empty texts get the score that a difference of zero has; a table without any
labelled row of one class gives the other class's share everywhere (0.5 with no labels); equal texts get
equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, discard, held_out, materialize, task
from codeweave.llm.labelled import logistic, probability, training_rows

LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    piece: int


@lru_cache(4)
def _compressors(good: bytes, bad: bytes):
    made = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
    return made


def difference(text: str, good: bytes, bad: bytes, piece: int) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text."""
    raw = text.encode()
    if not raw:
        return 0.0
    with_good, with_bad = _compressors(good, bad)
    step = -(-len(raw) // max(1, round(len(raw) / piece)))
    parts = [raw[i : i + step] for i in range(0, len(raw), step)]
    return (sum(len(with_bad.compress(p)) for p in parts) - sum(len(with_good.compress(p)) for p in parts)) / (len(raw) + 20)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the trainer finds the sample too small, the sample itself as raw content."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:] or b" " * 8


def _pieces(rows: DataFrame, piece: int, most: int) -> list[bytes]:
    """At most ``most`` pieces of ``piece`` characters, the same ones on every run."""
    cut = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))  # in one pass over a text, however long
    parts = rows.select("doc_id", F.posexplode(cut).alias("at", "piece"))
    chosen = parts.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(most)
    return [p.as_py().encode() for p in chosen.select("piece").toArrow().column("piece")]


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000, piece: int = 1000, pieces: int = 10_000, dictionary_size: int = 112_640) -> Model:
    rows = materialize(training_rows(docs, labels, "quality", most))
    even = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    texts = {y: _pieces(rows.where(even & ((F.col("y") == 1) == F.lit(y))), piece, pieces) for y in (True, False)}
    good, bad = (_dictionary(texts[y], dictionary_size) for y in (True, False))

    @task("quality")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("x", pa.float64())])
        for b in batches:
            yield batch_of(schema, b.column("y"), [difference(t, good, bad, piece) for t in b.column("text").to_pylist()])

    seen = rows.where(~even).select("y", "text").mapInArrow(measure, "y int, x double").toArrow()
    share = rows.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    discard(docs.sparkSession, rows)
    y = np.array(seen.column("y").to_numpy() == 1, float)
    x = np.array(seen.column("x").to_numpy(), float)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2 or not texts[True] or not texts[False]:
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Model(good, bad, (float(np.log(share / (1 - share))), 0.0), piece)
    scale = x.std() or 1.0
    w = logistic((x / scale)[:, None], y)
    return Model(good, bad, (float(w[0]), float(w[1] / scale)), piece)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    @task("quality")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([difference(t.as_py() or "", model.good, model.bad, model.piece) for t in b.column("text")], float)
            yield batch_of(schema, b.column("doc_id"), probability(np.array(model.weights), x[:, None]))

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

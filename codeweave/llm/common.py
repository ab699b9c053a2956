"""What the operators share: reading tables, written intermediates, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.plans.scratch import discard, materialize, release, scratch_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII rows take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [name for i in range(n + len(taken)) if (name := f"_own_{i}") not in taken][:n]


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that never trains anything; a null id trains nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


_tenant: list[str] = []
#: What frees the memory that an operator keeps in a worker between tasks.
cleaners: list[Callable[[], None]] = []


def _trim() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def begin(operator: str) -> None:
    """Called by a Python task as it starts. Workers are reused: what another operator kept in this one goes."""
    if _tenant and _tenant[0] != operator:
        for clean in cleaners:
            clean()
        _trim()
    _tenant[:] = [operator]


def task(operator: str) -> Callable:
    """For functions over Arrow batches: tidies the worker before the first batch and after the last."""

    def wrap(f: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(operator)
            try:
                yield from f(batches)
            finally:
                _trim()

        return run

    return wrap


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
    )


def parts_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices with about ``most`` bytes in ``column``; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_UNIT_START = re.compile(r"(?<!\s)(?= )")


def space_units(text: str) -> tuple[str, list[str]]:
    """Cut ``text`` before every blank that follows a non-space character.

    The byte-level pattern never lets a match run from a non-space character into a following
    blank, so encoding the units separately and concatenating equals encoding the whole text.
    Returns the first unit, and the others (each still beginning with its blank removed).
    """
    if _SPACE_BEFORE_SPACE.search(text) is None and not text.startswith(" "):
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _UNIT_START.split(text)
    return first, [u[1:] for u in rest]


def run_indices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total, dtype=np.int64)

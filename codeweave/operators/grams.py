"""A posting index for substring search: which texts have which runs of three characters.

A text that contains a query has all the query's grams, so a search reads the postings of these few grams, and only
texts that have them all are looked at. Grams are those of the lower-cased text, as searches ignore case. Texts are cut
into pieces first, so the memory for one is bounded whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

SIZE = 3
#: Characters that are cut into grams at once.
PIECE = 1 << 21
#: Rows of one Arrow batch.
ROWS = 1 << 12


def grams_of(text: Column, size: int = SIZE) -> Column:
    """Distinct runs of ``size`` characters of a piece of lower-cased text; shorter ones have none."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    cut = characters
    for k in range(2, size + 1):  # zipped with itself, moved on: the array is read once each time
        cut = F.zip_with(cut, F.slice(characters, F.lit(k), F.size(characters)), lambda a, b: F.concat(a, b))
    return F.when(F.char_length(text) >= size, F.array_compact(F.array_distinct(cut))).otherwise(F.array().cast("array<string>"))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _gathered(rows: list[tuple], size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams of (number of a key, text) rows: the grams in order; where the numbers of each end; the numbers.

    Characters are ranked among those that occur, so that a gram and a number are one integer, and sorting finds what is distinct.
    """
    points = np.frombuffer("".join(text for _, text in rows).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(text) for _, text in rows), np.int64, len(rows))
    letters = np.unique(points)
    ranks = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
    ranks[letters] = np.arange(len(letters))
    code = rank = ranks[points]
    for k in range(1, size):
        code = code[:-1] * len(letters) + rank[k:]
    whole = np.ones(len(points), bool)  # where a gram begins that lies within one text
    ends = np.cumsum(lengths)
    for k in range(1, size):
        whole[np.maximum(ends - k, ends - lengths)[lengths > 0]] = False
    whole = whole[: len(code)]
    numbers = np.fromiter((n for n, _ in rows), np.int64, len(rows))
    owners = np.repeat(numbers, lengths)[: len(code)][whole]
    code, several = code[whole], int(numbers.max(initial=0)) + 1
    kept = None
    if len(letters) ** size * several >= 1 << 63:
        kept, code = np.unique(code, return_inverse=True)
    pairs = code * several + owners
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    found = pairs // several
    begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(pairs) else pairs
    distinct = found[begins] if kept is None else kept[found[begins]]
    spelt = np.empty((len(distinct), size), np.uint32)
    for k in reversed(range(size)):
        distinct, last = np.divmod(distinct, max(len(letters), 1))
        spelt[:, k] = letters[last] if len(letters) else 0
    run = spelt.astype("<u4").tobytes().decode("utf-32-le")
    return [run[i : i + size] for i in range(0, len(run), size)], np.append(begins[1:], len(pairs)) if len(pairs) else begins, pairs - found * several


def _lists(stream: Iterator[tuple], size: int, piece: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, list]]:
    """(grams, where the numbers of each end, numbers, keys by number) of runs of (key, text) rows, in which rows of a key are neighbours; about ``piece`` characters at once."""
    rows: list[tuple] = []
    keys: list = []
    held = 0

    for key, texts in groupby(stream, key=lambda r: r[0]):
        mine: list[tuple] = []
        seen: set[str] = set()
        count = 0
        for _, text in texts:
            for i in range(0, max(len(text) - size, 0) + 1, piece):
                mine.append((0, text[i : i + piece + size - 1]))
                count += len(mine[-1][1])
                if count > piece:  # more than is held at once: what it has is added up
                    seen.update(_gathered(mine, size)[0])
                    mine, count = [], 0
        if seen:
            seen.update(_gathered(mine, size)[0])
            yield (alone := sorted(seen)), np.arange(1, len(alone) + 1), np.zeros(len(alone), np.int64), [key]
            continue
        rows += [(len(keys), text) for _, text in mine]
        keys.append(key)
        held += count
        if held >= piece:
            yield *_gathered(rows, size), keys
            rows, keys, held = [], [], 0
    if rows:
        yield *_gathered(rows, size), keys


def postings(texts: DataFrame, key: str, text: str, buckets: int = 16, size: int = SIZE, piece: int = PIECE, lists: bool = False) -> DataFrame:
    """(bucket, gram, key) for each distinct gram of each text, dealt out for a table partitioned by bucket and sorted by gram.

    A text without ``size`` characters has none, nor has a null. Keys may repeat: the grams are those of all their texts.
    With ``lists``, (bucket, gram, array ``key`` + s): a row for each gram of about ``piece`` characters of texts, with the keys that have it; a key is
    in one of a gram's lists. Only texts are shuffled, so that those of a key meet; a gram's keys are found together by sorting integers.
    """
    if not 1 <= size <= 3:
        raise ValueError("a gram has one to three characters")  # more don't fit an integer
    whole = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where(F.char_length("text") >= size)
    dealt = whole.repartition("key").sortWithinPartitions("key").select("key", F.col("text").cast("binary").alias("text"))
    of_key = to_arrow_type(dealt.schema["key"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((k, t.decode("utf-8", "replace")) for b in batches for k, t in zip(b.column("key").to_pylist(), (t.as_py() for t in b.column("text"))))
        for found, ends, numbers, keys in _lists(stream, size, piece):
            at, held = np.concatenate([[0], ends]).astype(np.int32), pa.array(keys, of_key)
            for i in range(0, len(found), ROWS):
                part = at[i : i + ROWS + 1]
                values = held.take(pa.array(numbers[part[0] : part[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + ROWS], pa.string()), pa.ListArray.from_arrays(pa.array(part - part[0]), values)], ["gram", "keys"])

    found = dealt.mapInArrow(work, StructType([StructField("gram", StringType()), StructField("keys", ArrayType(dealt.schema["key"].dataType))]))
    found = found.select(bucket_of(F.col("gram"), buckets).alias("bucket"), "gram", F.col("keys").alias(f"{key}s"))
    if lists:
        return found.sortWithinPartitions("bucket", "gram")
    return found.select("bucket", "gram", F.explode(f"{key}s").alias(key)).sortWithinPartitions("bucket", "gram", key)


def candidates(index: DataFrame, query: str, key: str, buckets: int = 16, size: int = SIZE) -> DataFrame | None:
    """Keys whose texts have every gram of ``query``, from the query's buckets alone; None where it is too short to have any."""
    asked = index.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(grams_of(F.lower("q"), size)).alias("gram"))
    wanted = {r["gram"]: r["bucket"] for r in asked.select("gram", bucket_of(F.col("gram"), buckets).alias("bucket")).collect()}  # as many as the query has
    if not wanted:
        return None
    read = index.where(F.col("bucket").isin(sorted(set(wanted.values()))) & F.col("gram").isin(sorted(wanted)))
    return read.groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(key)


def containing(texts: DataFrame, index: DataFrame, query: str, key: str, text: str, buckets: int = 16, size: int = SIZE) -> DataFrame:
    """Rows of ``texts`` that contain ``query`` in any case: candidates from the index, then the texts themselves; a short query reads them all."""
    found = candidates(index, query, key, buckets, size)
    rows = texts if found is None else texts.join(found, key, "left_semi")
    return rows.where(F.contains(F.lower(text), F.lower(F.lit(query))))

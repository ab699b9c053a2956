"""SimHash near-duplicates: meet-in-the-middle ball hashing, then connected components.

A fingerprint takes the majority bit of the XXH64 hashes of a text's word shingles. Two fingerprints
link at up to 3 differing bits, so a middle value lies within 1 bit of one and 2 bits of the other.
Every fingerprint that may link emits all variants within half the radius, rounded up: the 2,081 values
up to 2 bits away. After the shuffle on variants, the smallest fingerprint of a bucket that is within 1
bit of the variant is its centre, and the others are linked to it (they differ from it in at most 3
bits): a star, never all pairs, over at most 2,081 members by construction. Two fingerprints that differ
in up to 3 bits meet in a bucket that has a centre, so stars connect whatever links connect. Links are
made distinct and verified on their bits.

Which fingerprints may link is found first, without loss: with 64 bits in B blocks, 3 differing bits
leave B - 3 blocks equal, so fingerprints that share no choice of B - 3 blocks with another one have no
link, and emit no variants. B grows with the number of distinct fingerprints (:func:`blocks_for`), so
that chance keeps few of the unlinked ones at any size. Fingerprints are made distinct first, so copies
never multiply, and what is left is dealt out anew before variants are emitted.

Defined cases: texts without words (null, empty, white space) have fingerprint 0, linked like any
other; fewer words than a shingle count as one shingle; a null doc_id is fingerprinted and linked, and
is never the smallest id unless its component has no other; equal rows give equal rows; an empty
table gives no rows; other columns of the input are ignored. :func:`deduplicate` leaves one row of each
component, also where ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, discard, materialize, task
from codeweave.llm.components import components, one_of_each, text_digest

RADIUS = 3
BITS = 64
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[str], width: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        if n <= width:
            if n:
                hashes.append(digest(b" ".join(words), seed))
                counts[i] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - width] + 1))
        hashes += [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]
        counts[i] = n - width + 1
    out = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    h = np.array(hashes, np.uint64)
    first = np.cumsum(counts[full]) - counts[full]
    # blocks of up to 255 hashes of one text: eight byte-wide counters fit into one word
    per = (counts[full] + 254) // 255
    block_first = np.cumsum(per) - per
    block_start = np.repeat(first, per) + 255 * (np.arange(per.sum()) - np.repeat(block_first, per))
    bits = np.zeros((len(full), 64), bool)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, block_start)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first, axis=0)
        bits[:, j::8] = 2 * ones > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, digest of the text, fp long) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64())])

    @task("simhash")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                prints = fingerprints_of([t or "" for t in part.column("text").to_pylist()], width, seed)
                yield batch_of(schema, part.column("doc_id"), part.column("digest"), prints)

    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "text").mapInArrow(work, "doc_id long, digest binary, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{_signed(v)}L' for v in values)})")  # one call to the JVM, not one for each value


def blocks_for(n: int) -> int:
    """Blocks of which all but ``RADIUS`` are compared: so many that chance lets about one in 16 of ``n`` fingerprints through."""
    for blocks in range(2 * RADIUS, BITS // 4):
        kept = BITS * (blocks - RADIUS) // blocks
        if n * comb(blocks, RADIUS) <= 1 << (kept - 4):
            return blocks
    return BITS // 4


def block_masks(blocks: int) -> list[int]:
    """The bits of every choice of ``blocks - RADIUS`` blocks."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    one = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(one, blocks - RADIUS)]


def candidates(distinct: DataFrame, blocks: int) -> DataFrame:
    """The fingerprints that share all but ``RADIUS`` of their blocks with another one."""
    emitted = distinct.select("fp", F.posexplode(_masks(block_masks(blocks))).alias("k", "mask")).select(
        "fp", F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "k").alias("key")
    )
    shared = emitted.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key")
    # written, so that the join may read its size and split a hot key
    return emitted.join(materialize(shared), "key", "left_semi").select("fp").distinct()


def ball() -> list[int]:
    """The bits that lead to every variant within half the radius."""
    one = [1 << i for i in range(BITS)]
    return [0, *one, *(a | b for a, b in combinations(one, 2))]


def links(some: DataFrame) -> DataFrame:
    """Distinct verified links (u, v) that connect exactly what 3 or fewer differing bits connect."""
    tasks = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few fingerprints make many variants: dealt out first, so that no task emits them all
    variants = some.repartition(tasks, "fp").select("fp", F.explode(_masks(ball())).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    near = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= RADIUS // 2, F.col("fp"))
    met = variants.repartition(tasks, "variant").select("fp", F.min(near).over(Window.partitionBy("variant")).alias("centre"))
    pairs = met.where("fp <> centre").select(F.col("centre").alias("u"), F.col("fp").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def _linked(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, least id) of every distinct fingerprint, and (u, root) of those that aren't the root of their component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    some = materialize(candidates(distinct.select("fp"), blocks_for(distinct.count())))
    roots = components(links(some))
    discard(prints.sparkSession, some)
    return distinct, roots


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, width, seed).select("doc_id", "fp"))
    distinct, roots = _linked(prints)
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    discard(spark, roots)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component (see :func:`codeweave.llm.components.one_of_each`)."""
    prints = materialize(fingerprints(docs, width, seed))
    _, roots = _linked(prints)
    return one_of_each(docs, prints.withColumnRenamed("fp", "node"), roots)

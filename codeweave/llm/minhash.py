"""MinHash near-duplicates: fast similarity sketching, banding, and links confirmed on whole shingle sets.

A sketch has one coordinate for each row of each band. In round i every shingle of the set is hashed anew into
one coordinate, with a value i + v, v in [0, 1); a coordinate keeps its least value. After as many rounds as there are
coordinates, round i places every shingle into coordinate i minus their number, so all of them are filled at the
latest then. A set is done as soon as no coordinate is empty, as later rounds have larger values: about n rounds of
hashing in all are spent on k coordinates, not n * k. Coordinates of two sets are equal with the probability of their
Jaccard similarity and as concentrated as independent ones. Bands are chosen from the similarity
(:func:`bands_for`): a pair exactly at it shares none with a probability of at most ``MISS``, pairs above it with less.

Texts with equal sets are one node. What of the nodes that share a band is linked is found in steps whose work
is linear in them, each exact, and each leaving less to the next:

1. Every node is compared with one node of its bands, the least. Links make components; a band within one component
   is decided.
2. Shingles that no other node left has cannot be common: for a link, those of both nodes together, u and v, must
   keep (den + num) (u + v) <= (den - num) (n + m), which is weight(u, n) + weight(v, m) <= 0. The node of the least weight of a
   band is its centre. Nodes whose weight together with the centre's is positive link to nothing there; the others are
   compared with it. A page made of a common frame and words of its own is decided here, whatever their number.
3. What still shares a band across components goes into buckets by its rarest shingles: sets of n with a
   similarity of t share one among their n - ceil(t n) + 1 rarest. Buckets get step 2 again.
4. Nodes left in one bucket in different components meet in pairs, judged by sizes, weights and 2,048-bit sketches inside
   the join (bits in which two differ stand for as many shingles at least), and those that pass on their sets.

Nothing is capped: every pair that shares a band is compared, or excluded by a bound that a link can't break, or
connected already.

Defined cases: words are runs of bytes between ASCII white space, A-Z compared as a-z; fewer than ``width`` words
count as one shingle; texts without words (null, empty, white space) have an empty set and link with nothing, so
each is its own component; a null doc_id is linked like any other, and is a component_id only where no other id is
in the component (``kept`` is true there); equal rows give equal rows; rows of one id are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, discard, materialize, release, task
from codeweave.llm.components import components, text_digest

ROWS = 7
#: The greatest probability with which a pair exactly at the similarity shares no band.
MISS = 1e-5
#: 64-bit words of a sketch of bits.
SKETCH = 32
#: Shingles that are sketched at once.
AT_ONCE = 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends[width - 1 :])], np.uint64))


def bands_for(num: int, den: int) -> int:
    """Bands of ``ROWS`` coordinates, so that a pair with a similarity of num / den shares none with probability ``MISS`` at most."""
    return ceil(log(MISS) / log(1 - (num / den) ** ROWS))


def _mixed(x: np.ndarray, round_: int) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit hashes, other ones in each round."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (round_ + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coordinates(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The ``k`` coordinates of every set (none of them empty): the round in the upper half, the value in the lower."""
    out = np.full((len(sets), k), _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat, low, half = out.reshape(-1), np.uint64(0xFFFFFFFF), np.uint64(32)
    for i in range(2 * k):
        x = _mixed(h, i)
        bins = ((x >> half) * np.uint64(k) >> half).astype(np.int64) if i < k else i - k
        np.minimum.at(flat, of * k + bins, (np.uint64(i) << half) | (x & low))
        unfilled = (out == _EMPTY).any(axis=1)
        if not unfilled.any():
            return out
        more = unfilled[of]
        if not more.all():
            h, of = h[more], of[more]
    return out


def band_keys(sets: list[np.ndarray], bands: int) -> list[list[int]]:
    """Signed 64-bit keys of the bands of every set; none for an empty one."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in sets]
    if not full:
        return out
    digest, step = xxhash.xxh64_intdigest, 8 * ROWS
    for i, row in zip(full, coordinates([sets[i] for i in full], bands * ROWS)):
        raw = row.tobytes()
        out[i] = np.array([digest(raw[step * b : step * (b + 1)], b) for b in range(bands)], np.uint64).view(np.int64).tolist()
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The bits that a set's hashes hit, as signed words."""
    bits = np.zeros(64 * SKETCH, bool)
    bits[hashes >> np.uint64(64 - 6 - SKETCH.bit_length() + 1)] = True
    return np.packbits(bits).view(np.int64)


def _in_parts(ids: list, texts: pa.Array, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, about ``AT_ONCE`` shingles at a time."""
    some, sets, total = [], [], 0
    for i, t in zip(ids, texts):
        some.append(i)
        sets.append(shingles(t.as_py() or "", width))
        total += len(sets[-1])
        if total >= AT_ONCE:
            yield some, sets
            some, sets, total = [], [], 0
    if some:
        yield some, sets


def nodes(docs: DataFrame, similarity: tuple[int, int], width: int) -> DataFrame:
    """(doc_id, digest, node, n, bands) of every row: the digest of its text, and the digest, size and band keys of its set."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
    bands = bands_for(*similarity)

    @task("minhash")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist()))
            for some, sets in _in_parts(rows, b.column("text"), width):
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield batch_of(schema, [r[0] for r in some], [r[1] for r in some], node, [len(s) for s in sets], band_keys(sets, bands))

    return docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")).mapInArrow(work, "doc_id long, digest binary, node long, n long, bands array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the nodes in ``chosen`` (node, key, digest), from one text of each."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    @task("minhash")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, sets in _in_parts(b.column("node").to_pylist(), b.column("text"), width):
                yield batch_of(schema, some, [s.view(np.int64) for s in sets])

    # the id deals out the copies of one text; the digest decides
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("key"), text_digest(F.col("text")).alias("digest"), "text")
    found = texts.join(chosen, ["key", "digest"]).select("node", "text").mapInArrow(work, "node long, hashes array<long>")
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"))


class _Linker:
    """The steps from nodes that share a key to links; ``sets`` has the whole set of each of these nodes.

    Of the links found so far their components are kept, which new ones are added to.
    """

    def __init__(self, similarity: tuple[int, int], sets: DataFrame):
        self.num, self.den = similarity
        self.sets, self.spark = sets, sets.sparkSession
        self.written: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        self.written.append(materialize(df))
        return self.written[-1]

    def possible(self, n: Column | str, m: Column | str) -> Column:
        """Sizes that the similarity allows."""
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets are similar enough."""
        both = pairs.join(self.sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(self.sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
        common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sum"))
        return common.where(f"{self.den} * both >= {self.num} * (sum - both)").select("u", "v")

    def link(self, pairs: DataFrame) -> None:
        """Adds those of the pairs (u, v) that are links to the components."""
        more = self.keep(self.verified(pairs))
        if self.roots is None or not more.isEmpty():
            self.roots = components(more, self.roots)
            self.written.append(self.roots)

    def apart(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` (key, node, n) with their roots, of keys whose nodes lie in several components."""
        rooted = keyed.join(self.roots.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return self.keep(rooted.join(self.keep(split), "key", "left_semi"))

    def weighed(self, apart: DataFrame) -> DataFrame:
        """``apart`` with the weight of each node, from the shingles that no other of these nodes has."""
        here = self.sets.join(apart.select("node").distinct(), "node", "left_semi").select("node", F.explode("hashes").alias("h"))
        alone = here.groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
        own = alone.groupBy("node").agg(F.count("*").alias("own"))
        weight = F.coalesce("own", F.lit(0)) * (self.den + self.num) - F.col("n") * (self.den - self.num)
        return self.keep(apart.join(own, "node", "left").select("key", "node", "n", "root", weight.alias("weight")))

    def stars(self, keyed: DataFrame) -> DataFrame | None:
        """Adds the links to the centre of each key; the nodes of each that may link to others than it, or None where no key is left."""
        apart = self.apart(keyed)
        if apart.isEmpty():
            return None
        weighed = self.weighed(apart)
        centres = weighed.groupBy("key").agg(F.min(F.struct("weight", "node", "n", "root")).alias("c"))
        left = self.keep(weighed.join(self.keep(centres), "key").where("node <> c.node AND weight + c.weight <= 0"))
        pairs = left.where((F.col("root") != F.col("c.root")) & self.possible("n", "c.n")).select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v"))
        self.link(pairs.distinct())
        return left.select("key", "node", "n")

    def rarest(self, apart: DataFrame) -> DataFrame:
        """(key, node, n): the shared ones among the shingles of which two similar sets have one in common."""
        some = apart.select("node", "n").distinct()
        here = self.keep(self.sets.join(some, "node").select("node", "n", F.explode("hashes").alias("key")))
        shared = here.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
        ranked = here.join(self.keep(shared), "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("rare"))
        first = F.col("n") - F.ceil(F.col("n") * self.num / self.den) + 1 - (F.col("n") - F.size("rare"))  # shingles of its own are rarer
        return ranked.select(F.explode(F.slice("rare", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("r"), "node", "n").select("r.key", "node", "n")

    def pairs(self, keyed: DataFrame) -> DataFrame:
        """Pairs of one key in different components that sizes, weights and sketches let through."""
        apart = self.weighed(self.apart(keyed))
        bits = self.sets.join(apart.select("node").distinct(), "node", "left_semi").mapInArrow(_sketches, "node long, bits array<long>")
        ends = self.keep(apart.join(self.keep(bits), "node"))
        one = ends.select("key", F.col("node").alias("u"), "n", "root", "weight", *(F.col("bits")[i].alias(f"a{i}") for i in range(SKETCH)))
        other = ends.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("r"), F.col("weight").alias("w"), *(F.col("bits")[i].alias(f"b{i}") for i in range(SKETCH)))
        differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
        near = self.possible("n", "m") & (F.col("weight") + F.col("w") <= 0) & ((self.den + self.num) * differ <= (self.den - self.num) * (F.col("n") + F.col("m")))
        return one.join(other, (one["key"] == other["key"]) & (F.col("root") != F.col("r")) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()

    def links(self, members: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """Components that all pairs of one key, and those of ``near`` (u, v), make; ``members`` has key, node, n and the key's least node and its size."""
        nearest = members.where((F.col("node") != F.col("least.node")) & self.possible("n", "least.n")).groupBy("node").agg(F.min("least.node").alias("v"))
        pairs = nearest.select(F.col("v").alias("u"), F.col("node").alias("v"))
        self.link(pairs if near is None else near.unionByName(pairs).distinct())
        left = self.stars(members.select("key", "node", "n"))
        release(self.spark)
        if left is not None:
            again = self.apart(left)
            left = None if again.isEmpty() else self.stars(self.keep(self.rarest(again)))
        if left is not None:
            self.link(self.pairs(left))
        return self.roots


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("bits", pa.list_(pa.int64()))])
    for b in batches:
        bits = [sketch(np.asarray(h.values, np.int64).view(np.uint64)) for h in b.column("hashes")]
        yield batch_of(schema, b.column("node"), bits)


def linked(docs: DataFrame, prints: DataFrame, similarity: tuple[int, int], width: int, near: DataFrame | None = None) -> DataFrame:
    """(u, root) of nodes that aren't the least of their component; links are verified pairs that share a band or are in ``near`` (u, v)."""
    spark = docs.sparkSession
    text = F.struct(F.coalesce("doc_id", F.lit(0)).alias("key"), "digest")
    distinct = materialize(prints.where("n > 0").groupBy("node").agg(F.min(text).alias("text"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    emitted = distinct.select("node", "n", F.explode("bands").alias("key"))
    shared = materialize(emitted.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("last")).where("least.node < last").select("key", "least"))
    members = materialize(emitted.join(shared, "key").select("key", "node", "n", "least"))
    some = members.select("node") if near is None else members.select("node").unionByName(near.select(F.explode(F.array("u", "v")).alias("node")))
    chosen = distinct.join(some.distinct(), "node", "left_semi").select("node", "text.key", "text.digest")
    sets = materialize(_sets(docs, chosen, width))
    release(spark)
    linker = _Linker(similarity, sets)
    out = materialize(linker.links(members, near))
    for used in (distinct, shared, members, sets, *linker.written):
        discard(spark, used)
    return out


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (17, 20), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, of every row."""
    spark = docs.sparkSession
    prints = materialize(nodes(docs, similarity, width))
    roots = linked(docs, prints, similarity, width)
    least = prints.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialize(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("smallest")), "root").select("node", "smallest"))
    discard(spark, roots)
    component = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    out = prints.select("doc_id", "node", "n").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

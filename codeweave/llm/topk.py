"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are read in blocks; a block has one list a dimension, sorted by the component. Lists are read
in order only, from both ends, a slice at a time: the top of a list is what a query with a positive weight
wants first, its end what one with a negative weight wants. What has been read gives each candidate an
upper bound (unread components at their list's frontier) and a lower bound (unread components at the
list's other end). A query stops reading a block when no outsider's upper bound reaches the k-th score
that is sure so far; the few candidates that may still qualify have their final scores resolved. Lists
that are read to their ends leave no gap between the bounds, and those bounds are the scores.

What is sure so far is the best of the k-th score of earlier blocks and the k-th lower bound in this one.
A task orders the candidates it holds by the directions they have in common before it cuts blocks, so
blocks of unlike vectors are left after the heads of their lists.

Queries are written to the shared folder and go out in groups of bounded size, one at a time: the driver
holds one group and its broadcast, which is destroyed before the next; results are written. Candidates
are read in place, never shuffled. A partition gives at most k rows a query, merged by rank at the end.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows with a null vec_id; a query only meets candidates of its own length; a row never meets itself, but other
rows with its id are candidates, and every query row has its own k rows; equal scores go to the smaller id;
fewer than k candidates are all returned; no queries or an empty table give no rows; other columns are
ignored; scores beyond 2^53 are exact too; components and scores that don't fit into a long are cut to its ends
(where they tie).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, materialize, scratch_dir, task

BLOCK = 128
#: Candidates that a task orders before it cuts them into blocks, and bytes of query vectors that go out at once.
ORDERED, GROUP_BYTES = 32_768, 8 << 20
#: Shares of each list that have been read from either end when the bounds are looked at again.
DEPTHS = (0.0, 1 / 16, 1 / 4, 1.0)
#: Integers up to this size are exact as doubles.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(row, vec_id, x array<double>, asked) with floor(256 x), of vectors without null or non-finite components; ``row`` tells rows of one id apart."""
    whole = F.expr("forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(CAST(e AS DOUBLE)) < double('Infinity'))")
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    x = F.expr("transform(embedding, e -> CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE))")
    return some.select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked"))


class Best:
    """The k best (score, id, row) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s, i, r = (np.concatenate((a[query], b)) for a, b in ((self.score, scores), (self.id, ids), (self.row, rows)))
        best = np.lexsort((r, i, -s))[: self.score.shape[1]]
        self.score[query], self.id[query], self.row[query] = s[best], i[best], r[best]


class Lists:
    """The sorted lists of a block (rows of integers), read from both ends."""

    def __init__(self, block: np.ndarray):
        self.block, self.n = block, len(block)
        self.order = np.argsort(block, axis=0, kind="stable")  # one list a dimension: candidates by component
        self.dimensions = np.arange(block.shape[1])
        self.low, self.high = block[self.order[0], self.dimensions], block[self.order[-1], self.dimensions]
        self.from_top = np.zeros(block.shape, bool)
        self.from_end = np.zeros(block.shape, bool)
        self.top, self.end = self.high, self.low  # frontiers
        self.at = 0

    def read(self, upto: int) -> None:
        """The next entries of every list, to a depth of ``upto`` from either end."""
        if upto <= self.at:
            return
        top, end = self.order[self.n - upto : self.n - self.at], self.order[self.at : upto]
        self.from_top[top, self.dimensions] = True
        self.from_end[end, self.dimensions] = True
        self.top, self.end = self.block[top[0], self.dimensions], self.block[end[-1], self.dimensions]
        self.at = upto

    def bounds(self, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every candidate's score for queries with these positive and negative weights."""
        if not self.at:  # the heads alone: the same for all
            heads = [up @ a + down @ b for a, b in ((self.low, self.high), (self.high, self.low))]
            return heads[0][:, None], heads[1][:, None]
        seen_top, seen_end = (np.where(s, self.block, f) for s, f in ((self.from_top, self.top), (self.from_end, self.end)))
        upper = up @ seen_top.T + down @ seen_end.T
        if self.at == self.n:
            return upper, upper
        worst_top, worst_end = (np.where(s, self.block, f) for s, f in ((self.from_top, self.low), (self.from_end, self.high)))
        return up @ worst_top.T + down @ worst_end.T, upper


def exact_scores(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integers as Python integers, for products that doubles don't hold exactly."""
    q = [int(v) for v in query.tolist()]
    return np.array([sum(a * int(b) for a, b in zip(q, row)) for row in block.tolist()], object)


def read_block(queries: np.ndarray, query_rows: np.ndarray, block: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best, k: int) -> int:
    """Brings ``best`` up to date with a block of candidates; the list entries that queries read, an entry counted once for each query."""
    n, lists = len(block), Lists(block)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    own = {int(q): int(c) for q, c in zip(*np.nonzero(query_rows[:, None] == rows[None, :]))}
    alive, reads = np.arange(len(queries)), 0
    # sums of doubles may be off by this much where they aren't exact
    size = np.abs(queries) @ np.maximum(np.abs(lists.low), np.abs(lists.high))
    slack = np.where(size < EXACT, 0.0, size * (block.shape[1] + 2) * 2.0**-52)
    for depth in DEPTHS:
        lists.read(int(np.ceil(depth * n)))
        lower, upper = lists.bounds(up[alive], down[alive])
        sure = best.score[alive, -1].astype(float)
        shape = (len(alive), n)
        if lists.at and n > k:
            # the k-th lower bound of others than the query itself: one more than k, where it is in the block
            at = np.where(np.isin(alive, list(own)), n - k - 1, n - k)
            order = np.partition(lower, sorted({n - k - 1, n - k}), axis=1)
            sure = np.maximum(sure, order[np.arange(len(alive)), at])
        open_ = np.broadcast_to(upper, shape) >= (sure - slack[alive])[:, None]
        left = open_.sum(axis=1)
        # outsiders cannot qualify any more: none is left, or those that are left are few; at the end, all is read
        stop = (left == 0) | ((left <= max(4 * k, n // 32)) & (lists.at > 0)) | (lists.at == n)
        for place in np.flatnonzero(stop & (left > 0)).tolist():
            q = int(alive[place])
            rest = np.flatnonzero(open_[place])
            rest = rest[rest != own.get(q, -1)]
            if slack[q]:
                scores = exact_scores(block[rest], queries[q])
            else:
                scores = upper[place, rest] if lists.at == n else block[rest] @ queries[q]
            if len(rest):
                best.add(q, scores, ids[rest], rows[rest])
        reads += int(stop.sum()) * lists.at * block.shape[1]
        alive = alive[~stop]
        if not len(alive):
            break
    return reads


def alike(block: np.ndarray) -> np.ndarray:
    """An order of the rows that puts vectors with the same strongest directions together."""
    centred = block - block.mean(axis=0)
    _, _, directions = np.linalg.svd(centred[:: max(1, len(block) // 512)], full_matrices=False)
    return np.lexsort([centred @ d > 0 for d in directions[:12][::-1]])


RESULT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("cand", pa.int64()), ("score", pa.int64())])
_DDL = "query_row long, query_id long, vec_id long, cand long, score long"


class Search:
    """Candidates of one length against queries of that length."""

    def __init__(self, query_rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_rows, self.query_ids, self.queries, self.k = query_rows, query_ids, queries, k
        self.best, self.reads, self.entries = Best(len(queries), k), 0, 0

    def add(self, block: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not self.best.score.dtype.hasobject and np.abs(block).max(initial=0) * np.abs(self.queries).max(initial=0) * block.shape[1] >= EXACT:
            self.best.score = self.best.score.astype(object)
        order = alike(block)
        for i in range(0, len(order), BLOCK):
            part = order[i : i + BLOCK]
            self.reads += read_block(self.queries, self.query_rows, block[part], ids[part], rows[part], self.best, self.k)
            self.entries += len(self.queries) * block[part].size

    def result(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.best.row < np.iinfo(np.int64).max)
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        scores = [min(max(int(s), low), high) for s in self.best.score[q, place].tolist()]
        return batch_of(RESULT, self.query_rows[q], self.query_ids[q], self.best.id[q, place], self.best.row[q, place], scores)


def _search(candidates: DataFrame, groups: dict[int, tuple], k: int, path: str) -> None:
    """Writes the best candidates of every partition for the queries of one group (by length: rows, ids, vectors)."""
    shared = candidates.sparkSession.sparkContext.broadcast(groups)

    @task("topk")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {length: Search(*of, k) for length, of in shared.value.items()}
        held: dict[int, list[tuple]] = {length: [] for length in searches}

        def search(length: int) -> None:
            if held[length]:
                searches[length].add(*(np.concatenate(c) for c in zip(*held[length])))
                held[length].clear()

        for b in batches:
            size = np.diff(b.column("x").offsets.to_numpy())
            for length in searches:
                right = size == length
                if right.any():
                    x = b.column("x").filter(pa.array(right)).flatten().to_numpy().reshape(-1, length)
                    held[length].append((x, b.column("vec_id").to_numpy()[right], b.column("row").to_numpy()[right]))
                    if sum(len(h[0]) for h in held[length]) >= ORDERED:
                        search(length)
        for length, s in searches.items():
            search(length)
            yield s.result()

    candidates.select("row", "vec_id", "x").mapInArrow(work, _DDL).write.parquet(path)
    shared.destroy()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and integer score of the k best candidates of every query row."""
    spark = vectors.sparkSession
    all_ = materialize(usable(vectors, is_query))
    asked = all_.where("asked")
    paths, rows, held = [], [], 0

    def flush() -> None:
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(len(r["x"]), []).append(r)
        arrays = {n: (np.array([r["row"] for r in of]), np.array([r["vec_id"] for r in of]), np.array([r["x"] for r in of], float)) for n, of in groups.items()}
        paths.append(scratch_dir(spark))
        _search(all_, arrays, k, paths[-1])
        rows.clear()

    for r in asked.toLocalIterator():  # a group at a time
        rows.append(r)
        held += 8 * len(r["x"])
        if held >= group_bytes:
            flush()
            held = 0
    if rows:
        flush()
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(_DDL).parquet(*paths)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "cand")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

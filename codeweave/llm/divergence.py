"""Source divergence audit: how the terms of the sources of a language differ, in exact integers.

Byte-level tokenizer: the UTF-8 bytes of many texts lie in one buffer; a lookup table lower-cases A-Z and tells
term bytes (letters, and all bytes beyond ASCII) from others, and where that changes are the boundaries. Slices are grouped
by XXH3; every slice is then compared with the first of its group byte by byte, and slices with other
bytes than that are grouped by the bytes themselves. A task hands on one row for each term of a group and buffer, not one for
each occurrence.

Counts are added up by Spark, dealt out once, by lang and term: that serves the sums over sources too. Of each lang, the V
terms in at least ``least_docs`` documents are kept. With the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the
count of all kept terms of a group, the divergence of two shares is f = floor((p - q)^2 / (p + q)). Counts whose product with
10^9 leaves 64 bits are divided as decimals.

The terms of a lang are dealt into blocks by their hash, about ``CELLS`` entries each, so a lang of any size is
spread over many tasks. A task holds one block as a CSR matrix, source x term, and takes the divergences of each
source from all the later ones: with a the dense row of the first, the sum over terms is
sum over b's terms [f(a, b) - f(a, b0)] + sum over a's terms f(a, b0) + (other terms) f(a0, b0), where a0 and b0
are the shares of an absent term; both sums are ``reduceat`` over rows. Its work is the number of sources times the matrix entries.
Blocks' sums are added up by Spark.

Defined cases: null text, lang and source count as ''; texts without terms make a group, with no counts; a lang
without kept terms has pairs of value 0 and no terms; a lang with one source has no pairs; ids play no part, so rows
with equal or null ids are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, discard, materialize, run_indices, task

#: Bytes of text in one buffer; a longer text is a buffer of its own.
BUFFER = 12 << 20
#: Slices that are hashed at once.
SLICES = 1 << 17
#: Entries of the matrix of a block; with very many sources, as many as it has pairs of them, up to 64 times this.
CELLS = 1 << 17
UNIT = 10**9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TERM = (np.arange(256) >= 128) | ((_LOWER >= ord("a")) & (_LOWER <= ord("z")))


def boundaries(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer in lower case, and where its terms start and end."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = _TERM[buffer]
    steps = np.diff(inside)
    return _LOWER[buffer], np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def grouped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of the term of every slice, and the bytes of each term."""
    raw, digest = buffer.tobytes(), xxhash.xxh3_64_intdigest
    hashes = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), SLICES):
        some = zip(starts[i : i + SLICES].tolist(), ends[i : i + SLICES].tolist())
        hashes[i : i + SLICES] = np.fromiter((digest(raw[s:e]) for s, e in some), np.uint64)
    group, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[group[::-1]] = np.arange(len(group) - 1, -1, -1)
    lengths, model = ends - starts, first[group]
    same = lengths == lengths[model]
    for i in range(0, len(starts), SLICES):
        some = np.flatnonzero(same[i : i + SLICES]) + i
        size = lengths[some]
        equal = buffer[run_indices(starts[some], size)] == buffer[run_indices(starts[model[some]], size)]
        if len(some):
            same[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    terms = [raw[starts[i] : ends[i]] for i in first]
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):  # other bytes with a hash that is taken
        term = raw[starts[i] : ends[i]]
        if term not in known:
            known[term] = len(terms)
            terms.append(term)
        group[i] = known[term]
    return group, terms


def _counted(rows: list[tuple[str, str, bytes]]) -> tuple[list, list, list, list, list]:
    """lang, source, term, count and docs of the terms of some documents; each group also has a row without a term."""
    groups: dict[tuple[str, str], int] = {}
    of = np.array([groups.setdefault(r[:2], len(groups)) for r in rows], np.int64)
    ends = np.cumsum([len(r[2]) + 1 for r in rows])
    lower, starts, stops = boundaries(np.frombuffer(b"\n".join(r[2] for r in rows) + b"\n", np.uint8))
    lang, source = [g[0] for g in groups], [g[1] for g in groups]
    term: list = [None] * len(groups)
    count, docs = [0] * len(groups), [0] * len(groups)
    if len(starts):
        number, terms = grouped(lower, starts, stops)
        doc = np.searchsorted(ends, starts, "right")
        # cells of the group x term matrix, numbered as they come; its documents from the cells of document x term
        entry, cells = pd.factorize(of[doc] * len(terms) + number)
        in_doc = pd.unique(doc * len(terms) + number)
        fresh = of[in_doc // len(terms)] * len(terms) + in_doc % len(terms)
        names = list(groups)
        g, t = np.divmod(cells, len(terms))
        lang += [names[i][0] for i in g.tolist()]
        source += [names[i][1] for i in g.tolist()]
        decoded = [t.decode("utf-8", "replace") for t in terms]
        term += [decoded[i] for i in t.tolist()]
        count += np.bincount(entry, minlength=len(cells)).tolist()
        docs += np.bincount(pd.Index(cells).get_indexer(fresh), minlength=len(cells)).tolist()
    return lang, source, term, count, docs


_COUNTS = "lang string, source string, term string, count long, docs long"


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents; one row without a term for each group, also one without terms.

    Dealt out by lang and term.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    @task("divergence")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                rows.append((lang, source, text.as_py()))
                held += len(rows[-1][2])
                if held >= BUFFER:
                    yield batch_of(schema, *_counted(rows))
                    rows, held = [], 0
        if rows:
            yield batch_of(schema, *_counted(rows))

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(blank("lang"), blank("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    dealt = read.mapInArrow(work, _COUNTS).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)); the product leaves 64 bits beyond 9 * 10^9 occurrences, decimals hold it."""
    up, down = count + 2, n + 2 * v
    return F.when(up <= (2**63 - 1) // UNIT, _div(up * UNIT, down)).otherwise(_div(up.cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)"), down.cast("decimal(19,0)"))) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_sums(row: np.ndarray, column: np.ndarray, p: np.ndarray, absent: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each source its number and its divergences, over the terms of a block, from all later ones.

    ``row``, ``column`` and ``p`` are the entries of the source x term matrix in order of rows and columns; ``absent`` is
    the share that each source gives a term without occurrences.
    """
    k = len(absent)
    begin = np.searchsorted(row, np.arange(k + 1))
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    for a in range(k - 1):
        lo, hi = begin[a], begin[a + 1]
        dense = np.full(width, absent[a], np.int64)
        dense[column[lo:hi]] = p[lo:hi]
        # the terms of a against sources without them, then corrected where they have them
        out = (width - (hi - lo)) * _f(absent[a], absent[a + 1 :])
        for some in np.array_split(np.arange(lo, hi), max(1, (hi - lo) * (k - a) // CELLS)):
            out = out + _f(p[some][None, :], absent[a + 1 :, None]).sum(axis=1)
        later = slice(hi, None)
        if hi < len(row):
            against = dense[column[later]]
            terms = _f(against, p[later]) - _f(against, absent[row[later]])
            rows = filled[filled > a]
            out[rows - a - 1] += np.add.reduceat(terms, begin[rows] - hi)
        yield a, out


def _pairs(entries: DataFrame) -> DataFrame:
    """(lang, source, item, value) for a < b, over one block of a lang; rows without a term give the sources and their absent shares."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def work(table: pa.Table) -> pa.Table:
        is_term = table.column("term").is_valid()
        listed, held = table.filter(pa.compute.invert(is_term)), table.filter(is_term)
        lang = table.column("lang")[0].as_py()
        order = np.array(sorted(range(listed.num_rows), key=lambda i, s=listed.column("source").to_pylist(): s[i]), np.int64)
        names = listed.column("source").take(pa.array(order))
        absent = listed.column("p").to_numpy()[order]
        number = {s: i for i, s in enumerate(names.to_pylist())}
        row = np.array([number[s] for s in held.column("source").to_pylist()], np.int64)
        column = held.column("term").combine_chunks().dictionary_encode() if held.num_rows else None
        width = len(column.dictionary) if column is not None else 0
        index = column.indices.to_numpy().astype(np.int64) if column is not None else np.zeros(0, np.int64)
        by = np.lexsort((index, row))
        source, item, value = [], [], []
        for a, sums in block_sums(row[by], index[by], held.column("p").to_numpy()[by], absent, width):
            source.append(np.full(len(sums), a, np.int64))
            item.append(np.arange(a + 1, a + 1 + len(sums)))
            value.append(sums)
        if not source:
            return schema.empty_table()
        source, item = names.take(pa.array(np.concatenate(source))), names.take(pa.array(np.concatenate(item)))
        return pa.table([pa.array([lang] * len(source), pa.string()), source, item, pa.array(np.concatenate(value))], schema=schema)

    return entries.groupBy("lang", "block").applyInArrow(work, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence from every other source of the lang, and the terms that stand out most.

    Part ``pair``: every other source, all ranks. Part ``term``: kept terms with a greater share than in the whole lang, ranks to ``top``.
    """
    spark = docs.sparkSession
    term_of_lang = Window.partitionBy("lang", "term")  # a row for each source
    summed = counts(docs).withColumn("total", F.sum("count").over(term_of_lang)).withColumn("in_docs", F.sum("docs").over(term_of_lang))
    made = materialize(summed.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "count", "total"))
    held = made.where("term IS NOT NULL")
    sums = made.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("term").alias("entries"))
    langs = held.groupBy("lang").agg(F.count_distinct("term").alias("v"))
    per_lang = sums.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("entries").alias("entries"), F.count("*").alias("k"))
    wide = sums.select("lang", "source", "n").join(per_lang, "lang").join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    # as many blocks as the entries of the lang need; one where it keeps no terms, for its pairs
    size = F.greatest(F.lit(CELLS), F.least(F.col("k") * F.col("k"), F.lit(64 * CELLS)))
    groups = materialize(wide.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("entries") / size))))

    entry = held.join(groups, ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("total"), F.col("all"), F.col("v"))
    entries = entry.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", p.alias("p"))
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.greatest("v", F.lit(1)))).otherwise(1)
    markers = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), absent.alias("p"))
    once = _pairs(entries.unionByName(markers)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", "value", both.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    shares = entry.where("count > 0").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialize(pairs.withColumn("rank", F.row_number().over(order)).unionByName(best))
    for used in (made, groups):
        discard(spark, used)
    return out

"""Substring deduplication with repeated-phrase automata.

A word goes if a window of 50 consecutive words covers it whose word sequence also starts in a
document with a smaller doc_id. Windows are judged on the input.

1. *Phrases.* In each window the 6-word phrase with the smallest hash (the leftmost of equals) is its
   phrase; neighbouring windows mostly share it, and equal windows always have it at the same place.
   The windows of one phrase occurrence form a span; about 4 in 100 words start one. A scan gives, for each
   occurrence, the document, the phrase, and the span: how far it reaches to either side of the phrase, and
   the 128-bit digest of its text. It doesn't say where in the document that is.
2. *Confirm.* Grouped on a hash of the phrase (combined before the shuffle, so a phrase in a third of
   all documents moves a row per task), phrases of one document only go; the others are grouped on
   their text and span, and a span gets the smallest document that has it. If a later document has it too,
   the passage under it recurs, and goes from the later one.
3. *Automata.* Confirmed phrases are joined to their documents; each batch of documents is a shard: its
   phrases are compiled into an Aho-Corasick automaton, and all documents, with phrases or without, are
   streamed through the automaton of their shard. The automaton says where phrases occur; around every
   occurrence the text that a span would have there is digested and compared.
4. *Edges.* Where a phrase has several spans (a passage begins or ends), the first document of each
   span also gives the digests of its windows, at most 45 a span; grouped, they tell which of these
   windows an earlier document has.

All joins are on keys with one row on one side. Nothing is kept on the driver.

Defined cases: null text has no words; documents under 50 words lose nothing; a null doc_id is neither
smaller nor larger than others: such rows lose nothing and cost others nothing; rows with one doc_id
don't count as duplicates of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from codeweave.llm.common import batch_of, discard, fresh_names, materialize, parts_of, release, run_indices, task

WINDOW = 50
PHRASE = 6
#: Bytes of text of the documents whose phrases are compiled into one automaton; a longer document has one of its own.
SHARD = 1 << 18
_digest = xxhash.xxh3_128_digest

_rng = np.random.default_rng(20_25)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x20] = 0
_STEP = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64) if n else out


class Words:
    """The words of a batch of texts: one joined buffer, and hashes over it."""

    def __init__(self, texts: list[str | None]):
        split = [(t or "").encode().split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.counts) - self.counts
        self.n = int(self.counts.sum())
        self.blob = b" ".join([w for words in split for w in words])
        raw = np.frombuffer(self.blob, np.uint8)
        gaps = np.flatnonzero(raw == 0x20)
        self.start = np.concatenate(([0], gaps + 1)) if self.n else np.empty(0, np.int64)
        self.end = np.concatenate((gaps, [len(raw)])) if self.n else np.empty(0, np.int64)
        if self.n:
            size = self.end - self.start
            place = run_indices(np.zeros(self.n, np.int64), size + 1)[: len(raw)]
            powers = _powers(_BASE, int(size.max()) + 2)
            self.hash = _mix(np.add.reduceat(_BYTE[raw] * powers[place], self.start) + size.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def texts(self, first: np.ndarray, n: np.ndarray | int) -> list[bytes]:
        """The text of ``n`` words from each of the places ``first``."""
        return [self.blob[s:e] for s, e in zip(self.start[first].tolist(), self.end[first + n - 1].tolist())]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each phrase occurrence: its document, its first word, and the first words of its first and last window."""
        width = WINDOW - PHRASE + 1
        n = self.n - PHRASE + 1
        if n < width:
            return (np.empty(0, np.int64),) * 4
        value = self.hash[:n] * _STEP[0]
        for j in range(1, PHRASE):
            value = value + self.hash[j : j + n] * _STEP[j]
        value = _mix(value)
        index = np.arange(n, dtype=np.int64)
        have = 1
        while have < width:
            step = min(have, width - have)
            left, right = value[: len(value) - step], value[step:]
            keep = left <= right
            value = np.where(keep, left, right)
            index = np.where(keep, index[: len(index) - step], index[step:])
            have += step
        # windows that lie inside one document
        doc = np.flatnonzero(self.counts >= WINDOW)
        per = self.counts[doc] - WINDOW + 1
        window = run_indices(self.first[doc], per)
        of = np.repeat(doc, per)
        at = index[window]
        if not len(at):
            return (np.empty(0, np.int64),) * 4
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        return of[new], at[new], window[new], window[last]


#: ``reach``: 64 times the words of a span before its phrase, plus its windows less one.
PHRASES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("phrase", pa.binary()), ("reach", pa.int32()), ("span", pa.binary())])


def phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, phrase, reach, span): one row per phrase occurrence, without its place."""

    @task("substring_dedup")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b, "text", SHARD):
                words = Words(part.column("text").to_pylist())
                doc, at, low, high = words.spans()
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
                reach = ((at - low) * 64 + (high - low)).astype(np.int32)
                yield batch_of(PHRASES, ids[doc].astype(np.int64), keys[doc].astype(np.int64), words.texts(at, PHRASE), reach, list(map(_digest, words.texts(low, high - low + WINDOW))))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "text_key").mapInArrow(work, "doc_id long, text_key long, phrase binary, reach int, span binary")


def recurring(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose phrase several documents have; ``edge``: in different spans.

    Grouped on a 64-bit hash of the phrase, which can only let rows through that the text rules out later.
    """
    keyed = found.withColumn("key", F.xxhash64("phrase")).withColumn("of_span", F.xxhash64("reach", "span"))
    shared = keyed.groupBy("key").agg(*(f(c).alias(f"{n}_{c}") for c in ("doc_id", "of_span") for n, f in (("min", F.min), ("max", F.max))))
    # written, so that the join reads a table on either side and can split a hot phrase
    shared = materialize(shared.where("min_doc_id < max_doc_id").select("key", (F.col("min_of_span") != F.col("max_of_span")).alias("edge")))
    return keyed.join(shared, "key").select("doc_id", "text_key", "phrase", "reach", "span", "edge")


def confirmed(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, phrases): each document's phrases with the first document of their span, by the phrase's text.

    Spans that one document alone has matter at edges only.
    """
    span = ["phrase", "reach", "span"]
    spans = materialize(rows.groupBy(*span).agg(F.min("doc_id").alias("first")))
    known = rows.join(spans, span).where("edge OR first < doc_id")
    return known.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*span, "first", "edge")).alias("phrases"))


LOCATED_DDL = "doc_id long, text_key long, ranges array<struct<low:int,high:int>>, edges array<binary>, places array<int>"
_RANGE = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
LOCATED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("ranges", _RANGE), ("edges", pa.list_(pa.binary())), ("places", pa.list_(pa.int32()))])


def compiled(patterns: set[bytes]) -> ahocorasick.Automaton | None:
    """The automaton of one shard; each phrase is framed by blanks, so that it only matches whole words."""
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(f" {p.decode('latin-1')} ", p)
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton | None, text: bytes, starts: np.ndarray) -> list[tuple[int, bytes]]:
    """(word number, phrase) of every occurrence in a text of words joined by blanks, which begin at ``starts``."""
    if automaton is None or not text:
        return []
    hits = [(end - len(p) - 1, p) for end, p in automaton.iter(f" {text.decode('latin-1')} ")]
    return list(zip(np.searchsorted(starts, np.array([h[0] for h in hits], np.int64)).tolist(), (h[1] for h in hits)))


#: Of a phrase, by reach: the first documents of spans by digest, and whether the phrase has other spans.
Known = dict[bytes, dict[int, dict[bytes, tuple[int, bool]]]]


def _known(rows: list[dict] | None) -> Known:
    out: Known = {}
    for p in rows or ():
        out.setdefault(p["phrase"], {}).setdefault(p["reach"], {})[p["span"]] = (p["first"], p["edge"])
    return out


def extended(hits: list[tuple[int, bytes]], known: Known, text: bytes, starts: list[int], ends: list[int], own: int) -> tuple[set[tuple[int, int]], set[int]]:
    """Around each occurrence, the spans whose text is there: word ranges that an earlier document has, and first words of windows at edges."""
    ranges, edges = set(), set()
    for at, phrase in hits:
        for reach, spans in known.get(phrase, {}).items():
            low = at - (reach >> 6)
            last = low + (reach & 63)
            if low < 0 or last + WINDOW > len(starts):
                continue
            first, edge = spans.get(_digest(text[starts[low] : ends[last + WINDOW - 1]]), (None, False))
            if first is None:
                continue
            if first < own:
                ranges.add((low, last + WINDOW))
            elif edge:
                edges.update(range(low, last + 1))
    return ranges, edges


def locate(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Streams all documents through the automata of their shards: word ranges to remove, and window digests at edges.

    ``docs``: doc_id, text, text_key; ``known``: doc_id, text_key, phrases array<struct<phrase, reach, span, first, edge>>.
    """

    @task("substring_dedup")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b, "text", SHARD):
                of_doc = [_known(row) for row in part.column("phrases").to_pylist()]
                automaton = compiled({phrase for known_ in of_doc for phrase in known_})
                out = []
                for own, key, known_, t in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), of_doc, part.column("text")):
                    words = (t.as_py() or "").encode().split()
                    text = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
                    hits = occurrences(automaton, text, starts)
                    if not hits:
                        continue
                    starts, ends = starts.tolist(), ends.tolist()
                    ranges, edges = extended(hits, known_, text, starts, ends, own)
                    if ranges or edges:
                        places = sorted(edges)
                        windows = [_digest(text[starts[p] : ends[p + WINDOW - 1]]) for p in places]
                        out.append((own, key, [{"low": lo, "high": hi} for lo, hi in sorted(ranges)], windows, places))
                yield batch_of(LOCATED, *(zip(*out) if out else ([],) * 5))

    joined = docs.join(known, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "phrases")
    return joined.mapInArrow(work, LOCATED_DDL)


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, ranges): the word ranges to remove, for each document that loses words."""
    spark = docs.sparkSession
    found = materialize(phrases(docs))
    rows = materialize(recurring(found))
    discard(spark, found)
    release(spark)
    located = materialize(locate(docs, confirmed(rows)))
    discard(spark, rows)
    release(spark)
    at_edges = located.select("doc_id", "text_key", F.explode(F.arrays_zip("edges", "places")).alias("e")).select("doc_id", "text_key", F.col("e.edges").alias("window"), F.col("e.places").alias("at"))
    owned = at_edges.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first")
    late = at_edges.join(owned, "window").where("first < doc_id")
    more = late.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high"))).alias("ranges"))
    both = located.where("size(ranges) > 0").select("doc_id", "text_key", "ranges").unionByName(more)
    return both.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"))


KEPT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(text: str | None, ranges: list | None) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    if not ranges:
        return len(words), 0, b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [r["low"] for r in ranges], 1)
    np.add.at(change, [r["high"] for r in ranges], -1)
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay]).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_removed and kept (the words that stay, joined by one blank) of every document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    gone = covered(keyed.where("doc_id IS NOT NULL"))
    joined = keyed.join(gone, ["doc_id", "text_key"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *KEPT])

    @task("substring_dedup")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_kept(t.as_py(), r) for t, r in zip(b.column("text"), b.column("ranges").to_pylist())]
            yield batch_of(schema, b.column("doc_id"), b.column("text_key"), *(zip(*rows) if rows else ([], [], [])))

    return joined.select("doc_id", "text_key", "text", "ranges").mapInArrow(work, "doc_id long, text_key long, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words removed from ``text`` (and ``n_chars``, where there is one, counted anew).

    Texts that lose nothing stay as they are, byte by byte; documents that lose every word are left out.
    """
    key, id_, other, ranges = fresh_names(docs, 4)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    gone = covered(docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key")))
    gone = gone.withColumnsRenamed({"doc_id": id_, "text_key": other, "ranges": ranges})
    joined = keyed.join(gone, (keyed["doc_id"] == gone[id_]) & (keyed[key] == gone[other]), "left")

    def cut(batches):  # noqa: ANN001, ANN202
        for texts, gone_ in batches:
            yield pa.array([_kept(t.as_py(), r.as_py())[2] if r.is_valid and len(r) else t.as_py() for t, r in zip(texts, gone_)], pa.string())

    cut = F.arrow_udf(task("substring_dedup")(cut), "string", ArrowUDFType.SCALAR_ITER)

    out = joined.withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(cut("text", ranges)))
    out = out.where(F.col(ranges).isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(ranges).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)

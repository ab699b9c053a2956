"""Exact deduplication as a log-structured merge index, in DataFrame operations only.

*Memtable flush.* Rows are dealt to memtables by their digest's own run number, so that a memtable holds what
arrived together: input partition p belongs to run p mod ``RUNS``. A memtable combines its rows by digest to
(digest, id, copies) and is flushed as a run of level 0, sorted by digest, with a blocked Bloom filter.

*Compaction.* ``FAN`` runs of a level are merged into one run of the next, until one is left. An entry whose
digest the filters of the other runs of its merge rule out passes as it is; the others are combined by digest,
the smallest (or largest) identifier staying.

*Hits.* Entries of the last run with several copies are the hits. Their own filter is probed on the scan of the
texts, so only texts that may be hits are shuffled for *byte verification*: per digest the smallest and the
largest text are compared (each task reduces its texts to these two first, so a text that a third of all rows
share moves a row per task). Where they differ, rows are grouped by their own bytes.

A filter is broadcast, and takes 2 bytes an entry; where that would be more than ``FILTER_BYTES``, all entries
(or texts) are combined without one, with the same result.

The smallest-identifier rule of the index is a parameter: ``keep="first"`` keeps the smallest
doc_id, ``keep="last"`` the largest.

Defined cases: null text counts as empty (and equals an empty text); a null doc_id sorts before all
others; rows repeated with the same doc_id are rows of the group, each returned, and each kept if the
id stays, but ``deduplicate`` leaves one of them; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import ascii_lower, discard, fresh_names, materialize

#: Runs of level 0, and runs that a compaction merges.
RUNS, FAN = 16, 4
#: A filter block has 512 words of 64 bits, for 2,048 entries of 16 bits each; an entry sets this many bits of one block.
WORDS, PER_BLOCK, HASHES = 512, 2048, 4
#: The largest filter that is broadcast.
FILTER_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _pick(keep: str):
    return F.max if keep == "last" else F.min


def flush(rows: DataFrame, keep: str) -> DataFrame:
    """Level 0: (run, digest, id, copies), sorted by digest within a run. ``rows``: (run, digest, doc_id)."""
    entries = rows.groupBy("run", "digest").agg(_pick(keep)("doc_id").alias("id"), F.count("*").alias("copies"))
    return materialize(entries.sortWithinPartitions("run", "digest"))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _bits(digest: Column) -> list[tuple[Column, Column]]:
    """(word, bit) of every bit that an entry sets in its block."""
    found = []
    for i in range(HASHES):
        h = F.xxhash64(digest, F.lit(i))
        found.append((F.pmod(h, F.lit(WORDS)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")))
    return found


def filters(entries: DataFrame, group: str, blocks: int) -> DataFrame:
    """(group, block, words): a blocked Bloom filter of the digests of each group; a block without entries has no row."""
    bits = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(F.col("digest"))])
    set_ = entries.select(group, _block(F.col("digest"), blocks).alias("block"), F.explode(bits).alias("b"))
    one = F.expr("shiftleft(1L, b.bit)")
    words = set_.groupBy(group, "block", "b.word").agg(F.bit_or(one).alias("bits"))
    block = words.groupBy(group, "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))  # at most WORDS
    return block.select(group, "block", F.expr(f"transform(sequence(0, {WORDS - 1}), i -> coalesce(element_at(set, i), 0L))").alias("words"))


def _has(words: Column, digest: Column) -> Column:
    """Whether a filter block may hold a digest."""
    found = F.lit(True)
    for word, bit in _bits(digest):
        found = found & (F.getbit(F.get(words, word), bit) == 1)
    return found


def _blocks_for(entries: int) -> int:
    return -(-max(1, entries) // PER_BLOCK)


def merge(level: DataFrame, keep: str) -> DataFrame:
    """The next level: every ``FAN`` runs are one, and digests that several of them have are one entry."""
    spark = level.sparkSession
    sizes = {r["run"]: r["n"] for r in level.groupBy("run").agg(F.count("*").alias("n")).collect()}  # at most RUNS rows
    parent = F.floor(F.col("run") / FAN).cast("int")
    blocks = _blocks_for(max(sizes.values(), default=0))
    alone = None
    if sum(sizes.values()) * 2 <= FILTER_BYTES:
        of_runs = filters(level, "run", blocks)
        beside = of_runs.groupBy(parent.alias("parent"), "block").agg(F.collect_list(F.struct("run", "words")).alias("filters"))  # at most FAN of a block
        probed = level.withColumn("parent", parent).withColumn("block", _block(F.col("digest"), blocks)).join(F.broadcast(beside), ["parent", "block"])
        others = F.exists("filters", lambda f: (f["run"] != F.col("run")) & _has(f["words"], F.col("digest")))
        probed = materialize(probed.select(F.col("parent").alias("run"), "digest", "id", "copies", others.alias("elsewhere")))
        alone, level = probed.where("NOT elsewhere").drop("elsewhere"), probed.where("elsewhere").drop("elsewhere")
    else:
        level = level.withColumn("run", parent)
    merged = level.groupBy("run", "digest").agg(_pick(keep)("id").alias("id"), F.sum("copies").alias("copies"))
    return materialize((merged if alone is None else merged.unionByName(alone)).sortWithinPartitions("run", "digest"))


def compact(level: DataFrame, keep: str, runs: int = RUNS) -> DataFrame:
    """One run (digest, id, copies), merged level by level."""
    while runs > 1:
        after = merge(level, keep)
        discard(level.sparkSession, level)
        level, runs = after, -(-runs // FAN)
    return level.drop("run")


def differing(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The digests under which texts with different bytes are."""
    hits = index.where("copies > 1").select("digest")
    n = hits.count()
    texts = docs.select(normalised(F.col("text")).alias("norm"), digest_of(F.col("text")).alias("digest"))
    if 2 * n <= FILTER_BYTES:
        blocks = _blocks_for(n)
        of_hits = filters(hits.withColumn("all", F.lit(0)), "all", blocks).select("block", "words")
        probed = texts.withColumn("block", _block(F.col("digest"), blocks)).join(F.broadcast(of_hits), "block")
        texts = probed.where(_has(F.col("words"), F.col("digest"))).select("norm", "digest")
    return texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest")


def groups(docs: DataFrame, keep: str = "last") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = materialize(docs.select(F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), digest_of(F.col("text")).alias("digest"), "doc_id"))
    index = compact(flush(rows, keep), keep)
    differ = materialize(differing(docs, index))
    entries = rows.select("digest", "doc_id").join(index, "digest")
    if not differ.isEmpty():  # texts that only share a digest are grouped by their own bytes
        entries = entries.join(differ, "digest", "left_anti").unionByName(_by_bytes(docs, differ, keep))
    return entries.select(
        "doc_id",
        F.col("id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_bytes(docs: DataFrame, digests: DataFrame, keep: str) -> DataFrame:
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"), digest_of(F.col("text")).alias("digest")).join(digests, "digest")
    return texts.join(texts.groupBy("norm").agg(_pick(keep)("doc_id").alias("id"), F.count("*").alias("copies")), "norm").select("digest", "doc_id", "id", "copies")


def deduplicate(docs: DataFrame, keep: str = "last") -> DataFrame:
    """``docs`` with one row for each text: of rows with the id that stays, and of rows without an id if there are no others, one."""
    id_, digest, own = fresh_names(docs, 3)
    kept_rows = groups(docs, keep).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    stays = materialize(kept_rows.select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(digest), "times"))
    keyed = docs.withColumn(own, digest_of(F.col("text")))

    def of(keys: DataFrame) -> DataFrame:
        return keyed.join(keys.drop("times"), keyed["doc_id"].eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_semi")

    if stays.where("times > 1").isEmpty():
        return of(stays).select(*docs.columns)
    once = of(stays.where("times > 1")).dropDuplicates(["doc_id", own])
    return of(stays.where("times = 1")).unionByName(once).select(*docs.columns)

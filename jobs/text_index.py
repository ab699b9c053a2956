"""Job 1: keeps the substring index of a table of texts up to date.

    python -m jobs.text_index --source IN --out OUT --checkpoint CHECKPOINT [--config jobs/text_index.json]

Users search names, comments and documents for a part of a word. A scan of all texts for each search doesn't last; this
job keeps the postings that such a search starts from (:mod:`codeweave.operators.grams`), and takes only what is new:

* IN is a Parquet folder or file of documents (doc_id, text, lang). A file stream reads the files that came since the last run, and ends;
  its checkpoint knows which these are.
* Of these files' documents, those whose text is the one indexed already are left out, by the hash in the manifest.
* OUT/postings (batch, bucket, gram, doc_ids: those of some of the batch's documents) and OUT/manifest (batch, doc_id, lang, hash) get the others, a partition for each batch of
  the stream, postings first. A batch that is run again, after a failure, gets the same number and overwrites its own partition and
  no other; while it runs, the state that it compares with is that of the batches before it. So any run may be
  repeated, at any point, with the same result; with nothing new, nothing is written.

The last batch of a document holds its present text: :func:`current` drops the postings of earlier ones. A document that
comes twice in one batch with different texts counts as one with the grams of both. A null doc_id is skipped and logged,
as nothing could refer to it; a null text has a manifest row and no postings; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.operators import grams
from jobs.common import command, log, stored

DEFAULTS = {"buckets": 16, "max_files": 256}
MANIFEST = "doc_id long, lang string, hash string, batch long"
#: Batches written before lists were kept have a row for each doc_id.
POSTINGS = "gram string, doc_ids array<long>, doc_id long, batch long, bucket int"


def _as_pattern(path: str) -> str:
    """``path`` as a pattern that matches only itself: a stream takes no path of a single file, but patterns that find one."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, lang, hash, batch) of every document, as of its last batch."""
    rows = stored(spark, f"{out}/manifest", MANIFEST)
    last = rows.groupBy("doc_id").agg(F.max(F.struct("batch", "hash", "lang")).alias("m"))
    return last.select("doc_id", "m.lang", "m.hash", "m.batch")


def current(spark: SparkSession, out: str) -> DataFrame:
    """(gram, doc_id, bucket) of the present text of every document.

    Postings are joined, and so shuffled, only where a document has come again; of batches without a manifest none are read.
    """
    rows, postings = stored(spark, f"{out}/manifest", MANIFEST), stored(spark, f"{out}/postings", POSTINGS)
    postings = postings.join(F.broadcast(rows.select("batch").distinct()), "batch", "left_semi")  # a row a batch
    postings = postings.select("gram", F.explode(F.coalesce("doc_ids", F.array("doc_id"))).alias("doc_id"), "batch", "bucket")
    again = rows.groupBy("doc_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).where("first < last").select(F.col("doc_id").alias("id"), "last")
    if not again.isEmpty():
        postings = postings.join(again, (F.col("doc_id") == F.col("id")) & (F.col("batch") < F.col("last")), "left_anti")
    return postings.select("gram", "doc_id", "bucket")


def search(spark: SparkSession, out: str, docs: DataFrame, query: str, buckets: int = DEFAULTS["buckets"]) -> DataFrame:
    """The rows of ``docs`` (as indexed) that contain ``query`` in any case."""
    return grams.containing(docs, current(spark, out), query, "doc_id", "text", buckets)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Indexes what came to ``source`` since the last run with this ``out`` and ``checkpoint``; how much was read and written."""
    settings = {**DEFAULTS, **(config or {})}
    totals = {"batches": 0, "read": 0, "without_id": 0, "indexed": 0, "postings": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = stored(session, f"{out}/manifest", MANIFEST).where(F.col("batch") < number).groupBy("doc_id").agg(F.max(F.struct("batch", "hash")).alias("m")).select("doc_id", "m.hash")
        rows = batch.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
        new = rows.where("doc_id IS NOT NULL")
        if not before.isEmpty():  # or the join would shuffle all texts for nothing
            new = new.join(before, ["doc_id", "hash"], "left_anti")
        lists = grams.postings(new, "doc_id", "text", settings["buckets"], grams.SIZE, grams.PIECE, True)
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings/batch={number}")
        once = new.groupBy("doc_id").agg(F.max(F.struct("hash", "lang")).alias("m")).select("doc_id", "m.lang", "m.hash")
        once.write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")
        seen = batch.agg(F.count("*").alias("read"), F.count_if(F.col("doc_id").isNull()).alias("without_id")).first()
        found = {**seen.asDict(), "indexed": stored(session, f"{out}/manifest/batch={number}", MANIFEST).count(), "postings": stored(session, f"{out}/postings/batch={number}", POSTINGS).agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]}
        totals["batches"] += 1
        for k, n in found.items():
            totals[k] += n
        log.info("batch %d: %s", number, found)

    log.info("reading what is new in %s", source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["max_files"]).parquet(_as_pattern(source))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote to %s: %s", out, totals)
    return totals


if __name__ == "__main__":
    command(__doc__, "jobs/text_index.json", DEFAULTS, lambda spark, a, config: run(spark, a.source, a.out, a.checkpoint, config), "source", "out", "checkpoint")

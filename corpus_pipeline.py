"""The corpus pipeline: toxic documents out, exact and near copies out, repeated passages out, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from codeweave.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from codeweave.llm.common import discard, materialize, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from the labelled ones that aren't held out."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="last")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on 5-word shingles, the one with the smallest doc_id.

    Candidates by SimHash fingerprints within 3 bits, and by bands of sketches for what those miss; links are confirmed on whole sets.
    """
    return near_dedup.deduplicate(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 50-word windows that an earlier document has."""
    return substring_dedup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("packing", pack),
]

#: Toxicity scores, fingerprints and token ids have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        after = materialize(stage(spark, docs, sf_dir))
        if number:
            discard(spark, docs)
        release(spark)
        docs = after
    return docs

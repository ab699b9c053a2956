"""Near-duplicates by word shingles: sets of five words, linked at a Jaccard similarity of 0.8 or more, one row of each group.

Candidates come from SimHash first: texts whose fingerprints differ in 3 or fewer bits (:mod:`codeweave.llm.simhash`), each
confirmed on whole sets. Balls alone cannot do the job: at 0.8 two 64-bit fingerprints differ in about 10 bits, far beyond any
radius that a ball can have. So bands of sketches (:mod:`codeweave.llm.minhash`) join in for the others, with links
confirmed on whole sets, and no pairs of a band's members beyond what its bounds leave.

Defined cases: words are runs of bytes between ASCII white space, A-Z compared as a-z; fewer than five
words count as one shingle; texts without words (null, empty, white space) are equal to each other; of a
component the row with the smallest doc_id stays, a null id only if there is no other, and of rows with
the same id the one with the smallest digest; of equal rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm import simhash
from codeweave.llm.common import discard, materialize, release
from codeweave.llm.components import one_of_each
from codeweave.llm.minhash import SKETCH, linked, nodes, sketch  # noqa: F401

WIDTH = 5
SIMILARITY = (4, 5)


def close(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes to confirm, from fingerprints with 3 or fewer differing bits.

    Of nodes with one fingerprint each meets the least, and of linked fingerprints the least nodes meet: stars, never all pairs.
    """
    spark = docs.sparkSession
    marks = simhash.fingerprints(docs).select("digest", "fp").distinct()
    marked = materialize(marks.join(prints.where("n > 0").select("digest", "node").distinct(), "digest").select("node", "fp").distinct())
    centres = materialize(marked.groupBy("fp").agg(F.min("node").alias("node")))
    some = materialize(simhash.candidates(centres.select("fp"), simhash.blocks_for(centres.count())))
    met = materialize(simhash.links(some))
    same = marked.join(centres.withColumnRenamed("node", "centre"), "fp").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    ends = lambda fp, node: centres.select(F.col("fp").alias(fp), F.col("node").alias(node))
    linked = met.join(ends("u", "a"), "u").join(ends("v", "b"), "v").select("a", "b")
    out = materialize(same.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    for used in (marked, centres, some, met):
        discard(spark, used)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component."""
    spark = docs.sparkSession
    prints = materialize(nodes(docs, SIMILARITY, WIDTH))
    near = close(docs, prints)
    release(spark)
    roots = linked(docs, prints, SIMILARITY, WIDTH, near)
    out = one_of_each(docs, prints.select("doc_id", "digest", "node"), roots)
    for used in (prints, near, roots):
        discard(spark, used)
    return out

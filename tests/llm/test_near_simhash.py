"""The near-dedup stage's SimHash step: fingerprints within 3 bits are candidates, and are confirmed on whole sets."""

import random

import corpus_pipeline

from codeweave.llm import minhash, near_dedup
from codeweave.llm.common import materialize
from codeweave.llm.simhash import fingerprints_of


def planted():
    """Texts of 600 words with one changed; two that one run of words fills, with different ends; two without words."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = fresh(600)
        texts += [base, [*base[:300], "changed", *base[301:]]]
    run = fresh(3) * 200
    texts += [run + fresh(8), run + fresh(8), [], []]
    return {i: " ".join(t) for i, t in enumerate(texts)}


def bits(rows, i, j):
    a, b = fingerprints_of([rows[i], rows[j]]).tolist()
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_simhash_links_without_any_band(spark, monkeypatch):
    """With bands that nothing shares, texts within 3 bits are linked all the same, and only if their sets are similar."""
    rows = planted()
    near = {(i, i + 1) for i in range(0, 24, 2) if bits(rows, i, i + 1) <= 3}
    assert len(near) >= 3 and bits(rows, 24, 25) <= 3
    monkeypatch.setattr(minhash, "band_keys", lambda sets, bands: [[hash(s.tobytes()) & (2**62 - 1)] for s in sets])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    prints = materialize(near_dedup.nodes(docs, near_dedup.SIMILARITY, near_dedup.WIDTH))
    node = {r["node"]: r["doc_id"] for r in prints.collect() if r["n"]}
    found = {tuple(sorted((node[r["u"]], node[r["v"]]))) for r in near_dedup.close(docs, prints).collect()}
    assert found == near | {(24, 25)}
    stay = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert stay == rows.keys() - {j for _, j in near} - {27}

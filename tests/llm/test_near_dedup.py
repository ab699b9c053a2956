import random

import corpus_pipeline
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.llm import exact_dedup, near_dedup
from codeweave.llm.common import materialize
from tests.llm.test_dedup import WORD, lower


def brute_stay(rows, width=5):
    """Ids that stay: of documents reachable over Jaccard similarities of 0.8 or more, the smallest; every pair is compared."""
    ids = sorted(rows)
    sets = []
    for i in ids:
        w = WORD.findall(lower(rows[i]))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {ids[find(i)] for i in range(len(ids))}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.floats(0, 0.4))
def test_sketches_never_rule_out_a_link(seed, n, changed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, np.uint64)
    b = np.concatenate((a[: n - int(changed * n)], rng.integers(0, 1 << 63, rng.integers(0, n + 1), np.uint64)))
    differ = int(np.bitwise_count((near_dedup.sketch(a) ^ near_dedup.sketch(b)).view(np.uint64)).sum())
    one, other = set(a.tolist()), set(b.tolist())
    assert differ <= len(one ^ other)
    if 5 * len(one & other) >= 4 * len(one | other):
        assert 9 * differ <= len(one) + len(other)
    assert near_dedup.sketch(a).shape == (near_dedup.SKETCH,) and int(np.bitwise_count(near_dedup.sketch(a).view(np.uint64)).sum()) <= n


def test_stage_removes_near_copies_of_documents(spark):
    docs = materialize(exact_dedup.deduplicate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stay = brute_stay(rows)
    assert len(stay) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == stay


def test_stage_on_planted_copies(spark):
    """Pairs a little above and below 0.8, a chain whose ends are apart, and a large group with one common passage."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (27, 28, 29, 30, 31, 200):
        for changed in (0.1, 0.105, 0.115, 0.2):
            base = fresh(n)
            texts += [base, base[: n - round(changed * n)] + fresh(round(changed * n))]
    chain = fresh(100)
    for i in range(8):
        texts.append(chain := chain[6:] + fresh(6))
    common = fresh(60)
    texts += [common + fresh(rng.randrange(3, 40)) for _ in range(60)]
    rows = {i * 7 % 1009: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == brute_stay(rows)


def test_stage_keeps_one_of_rows_with_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text), (1, text), (2, text + " more"), (None, text), (None, "alone"), (None, "alone"), (5, "else"), (5, "other"), (6, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text), (None, "alone"), (5, "else"), (5, "other")], key=str)

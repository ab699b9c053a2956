import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.llm import divergence, minhash
from tests.llm.test_dedup import WORD, lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_links(rows, num=17, den=20, width=5):
    """(n, smallest id reachable) of every id; all pairs are compared."""
    ids = sorted(rows)
    sets = {}
    for i in ids:
        w = WORD.findall(lower(rows[i] or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def linked(spark, rows, **how):
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, **how).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 64))
def test_coordinates_are_the_least_of_all_rounds(sets, k):
    """Filled to the last one, and equal to the rounds carried to their end for each set alone."""
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = minhash.coordinates(arrays, k)
    for a, row in zip(arrays, got):
        want = [2**64] * k
        for i in range(2 * k):
            for x in minhash._mixed(a, i).tolist():
                b = ((x >> 32) * k) >> 32 if i < k else i - k
                want[b] = min(want[b], (i << 32) | (x & 0xFFFFFFFF))
        assert row.tolist() == want


def test_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((10, 8), (300, 240), (5000, 4000)):
        equal = []
        for _ in range(40):
            shared = rng.integers(0, 1 << 63, common, np.uint64)
            a, b = (np.unique(np.concatenate((shared, rng.integers(0, 1 << 63, n - common, np.uint64)))) for _ in range(2))
            x, y = minhash.coordinates([a, b], 210)
            equal.append((x == y).mean())
        assert abs(np.mean(equal) - common / (2 * n - common)) < 0.03 and np.std(equal) < 0.06


def test_links_around_the_similarity(spark):
    """Pairs a little above and below 0.85, a chain whose ends are apart, one common passage, and copies of all."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (27, 29, 40, 200):
        for changed in (0.05, 0.07, 0.075, 0.08, 0.085, 0.2):
            base = fresh(n)
            texts += [base, base[: n - round(changed * n)] + fresh(round(changed * n))]
    chain = fresh(100)
    for _ in range(8):
        texts.append(chain := chain[5:] + fresh(5))
    common = fresh(60)
    texts += [common + fresh(rng.randrange(3, 40)) for _ in range(60)]
    texts += [t for t in texts[::9]]
    rows = {i * 7 % 1009: " ".join(t) for i, t in enumerate(texts)}
    assert linked(spark, rows) == brute_links(rows)


def test_pages_of_a_frame_in_families(spark):
    """All pages have a frame, those of a family another part, each words of its own: bands across families, links inside some."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    frame, rows = fresh(160), {}
    for family in range(12):
        part = fresh(36)
        for page in range(8):
            rows[len(rows)] = " ".join(frame + part + fresh(2 if family % 2 else 22))
    want = brute_links(rows)
    assert 12 < len({c for _, c in want.values()}) < 96
    assert linked(spark, rows) == want


def test_many_pages_of_one_frame_make_no_pairs(spark, monkeypatch):
    """400 pages a little below the similarity share bands with nearly all others; none is paired with all of them."""
    rng = random.Random(9)
    frame = [f"f{i}" for i in range(400)]
    rows = {i: " ".join(frame + [f"w{rng.randrange(10**9)}" for _ in range(36)]) for i in range(400)}
    compared = []
    verified = minhash._Linker.verified

    def counted(self, pairs):
        compared.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(minhash._Linker, "verified", counted)
    assert linked(spark, rows) == brute_links(rows)
    assert sum(compared) <= 3 * len(rows)


def test_odd_rows_link_as_defined(spark, odd, nothing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()), key=str)
    want = [(i, 0, i, True) for i in (0, 1, 2)] + [(3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (None, 1, 4, False)]
    want += [(7, 1, 7, True), (8, 1, 8, True), (9, 2, 9, True), (10, 1, 10, True), (11, 1, 11, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(nothing).count() == 0
    alone = odd.where("doc_id IS NULL")
    assert [tuple(r) for r in minhash.near_duplicates(alone).collect()] == [(None, 1, None, True)]


def brute_audit(rows, least=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [lower(t) for t in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: c[t] for t in kept} for (la, s), c in groups.items() if la == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in mine.items()}, p(whole)
        for s in mine:
            pair = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            term = [(-f(shares[s][t], q[t]), t.encode()) for t in kept if mine[s][t] > 0 and shares[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


def audited(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "漢字", "e", "ÀÉ", "zz9q", "x-y", "ß", "Ünï"] + [f"{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    sources = ["s1", "s2", "S", "", "ü"]
    return [(rng.choice(["en", "fr"]), s := rng.choice(sources), " ".join(rng.choice(words[: 20 + 15 * sources.index(s)]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_audit_equals_plain_integers(spark, monkeypatch, cells):
    """Any size of blocks gives the same sums."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = corpus(cells, 300)
    got = audited(spark, rows)
    assert got == brute_audit(rows)
    assert len({r[0] for r in got}) == 2 and any(r[2] == "term" for r in got)


def test_audit_of_odd_tables(spark, odd, nothing):
    rows = [(None, None, None), ("en", "a", ""), ("en", None, "one two"), ("fr", "only", "un deux " * 50), ("en", "b", "12 !? \x00"), ("xx", "a", None), ("xx", "b", None)] + [("de", "k", "das Wort")] * 10
    rows += [("de", "l", "wort " * 30_000), ("de", "m", "")]
    assert audited(spark, rows) == brute_audit(rows)
    assert divergence.audit(nothing).count() == 0
    assert {r["part"] for r in divergence.audit(odd, least_docs=1).collect()} == {"term"} or divergence.audit(odd, least_docs=1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbZz@[`{é漢\x00 \n9ß", max_size=20), min_size=1, max_size=6))
def test_terms_of_a_buffer(texts):
    _, _, terms, counts, docs = divergence._counted([("l", "s", t.encode()) for t in texts])
    want, seen = Counter(), Counter()
    for t in texts:
        found = [lower(x) for x in TERM.findall(t)]
        want.update(found)
        seen.update(set(found))
    assert {t: n for t, n in zip(terms, counts) if t is not None} == want
    assert {t: n for t, n in zip(terms, docs) if t is not None} == seen


def test_slices_with_one_hash_are_told_apart(monkeypatch):
    """With a hash of 2 values, nearly all slices collide; their bytes decide."""
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    words = [b"one", b"two", b"six", b"four", b"five", b"one", b"four", b"seven"]
    buffer, starts, ends = divergence.boundaries(np.frombuffer(b" ".join(words), np.uint8))
    group, terms = divergence.grouped(buffer, starts, ends)
    assert [terms[g] for g in group] == words and len(set(terms)) == len(terms)


def test_shares_are_exact_beyond_a_product_of_64_bits(spark):
    cases = [(0, 1, 1), (5, 7, 3), (10**12, 3 * 10**12, 10**6), (8 * 10**15, 8 * 10**15 + 5, 10**7), (3, 10**15, 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = {(r["c"], r["n"]): r["p"] for r in df.select("c", "n", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()}
    assert got == {(c, n): 1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases}

import hashlib
import random
import re

import pytest
import xxhash

from codeweave.llm import components, exact_dedup, simhash, substring_dedup
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("filter_bytes", [exact_dedup.FILTER_BYTES, -1])
def test_exact_groups(spark, odd, nothing, monkeypatch, filter_bytes):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", filter_bytes)
    rows = [(r["doc_id"], lower(r["text"])) for r in odd.collect()]
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, []).append(i)
    expected = sorted(
        ((i, max((x for x in by_text[t] if x is not None), default=None), len(by_text[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str
    )
    got = exact_dedup.groups(odd.repartition(7)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.groups(nothing).count() == 0
    first = {r["doc_id"]: r["keep_id"] for r in exact_dedup.groups(odd.where("doc_id IS NOT NULL"), keep="first").collect()}
    assert first[6] == 4 and first[2] == 2


def test_merge_levels_and_their_filters(spark):
    """Entries that several runs have are combined; filters let all of them through, and few others."""
    from pyspark.sql import functions as F

    rows = [(run, f"{run}_{i}" if i % 10 else f"all_{i}", run * 10_000 + i) for run in range(16) for i in range(3000)]
    level = exact_dedup.flush(spark.createDataFrame(rows, "run int, t string, doc_id long").select("run", F.unhex(F.sha2("t", 256)).alias("digest"), "doc_id"), "first")
    assert level.count() == len(rows)
    shown = []
    for runs in (4, 1):
        level = exact_dedup.merge(level, "first")
        shown.append(level.groupBy("run").count().count())
        assert level.count() == 16 * 2700 + runs * 300
    assert shown == [4, 1]
    assert sorted((r["id"], r["copies"]) for r in level.where("copies > 1").collect()) == [(i, 16) for i in range(0, 3000, 10)]
    of_hits = exact_dedup.filters(level.where("copies > 1"), "run", exact_dedup._blocks_for(300)).select("block", "words")
    probe = level.withColumn("block", exact_dedup._block(F.col("digest"), 1)).join(of_hits, "block").where(exact_dedup._has(F.col("words"), F.col("digest")))
    assert 300 <= probe.count() <= 300 + 16 * 2700 * 0.01
    assert probe.where("copies > 1").count() == 300


def test_only_texts_that_may_be_copies_are_shuffled(spark):
    """The filter of the hits is probed below the exchange of the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = exact_dedup.compact(exact_dedup.flush(docs.selectExpr("0 AS run", "unhex(sha2(lower(text), 256)) AS digest", "doc_id"), "last"), "last")
    plan = exact_dedup.differing(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(digest") < plan.index("getbit") and "BroadcastHashJoin" in plan


def test_exact_deduplicate_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A", "x", b"y", "z", 5), (2, "a", None, None, None, 6)], "doc_id long, text string, _digest string, digest binary, _own_0 string, run int")
    assert [tuple(r) for r in exact_dedup.deduplicate(docs).collect()] == [(2, "a", None, None, None, 6)]


def test_exact_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    """With a digest that all texts share, groups are still those of the bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.groups(docs).collect()} == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)}


def test_exact_deduplicate(odd, nothing):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_exact_deduplicate_leaves_one_of_equal_rows(spark):
    rows = [(3, "A b")] * 50 + [(1, "a b"), (None, "a b"), (None, "alone"), (None, "Alone"), (7, "c"), (7, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"].lower()) for r in exact_dedup.deduplicate(docs).collect()), key=str)
    assert got == sorted([(3, "a b"), (None, "alone"), (7, "c"), (7, "d")], key=str)


def brute_print(t, width=3):
    words = WORD.findall(lower(t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest index reachable over differences of up to three bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    texts = [t or "" for t in ODD] + ["one two three", "one two three four five six " * 90]
    assert [int(f) & (1 << 64) - 1 for f in simhash.fingerprints_of(texts)] == [brute_print(t) for t in texts]


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = [brute_print(t) for _, t in rows]
    expected = {rows[i][0]: (f"{p:016x}", rows[root][0]) for i, (p, root) in enumerate(zip(prints, linked(prints)))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == expected


@pytest.mark.parametrize("blocks", [6, 9, 16])
def test_links_of_planted_fingerprints(spark, blocks):
    """Chains and clusters at one, two, three and four bits, over both halves."""
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(4):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                base ^= 1 << b
            prints.append(base)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["u"]: r["root"] for r in components.components(simhash.links(simhash.candidates(df, blocks))).collect()}
    mine = {}
    for p, s in zip(prints, signed):
        mine.setdefault(roots.get(s, s), set()).add(p)
    expected = {}
    for p, i in zip(prints, linked(prints)):
        expected.setdefault(i, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, expected.values()))


def test_blocks_grow_with_the_fingerprints():
    sizes = [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == 6 < sizes[-1]
    for blocks in set(sizes):
        masks = simhash.block_masks(blocks)
        assert all(any(not m & bits for m in masks) for bits in (1, 7, 1 | 1 << 31 | 1 << 63, 1 << 20 | 1 << 40 | 1 << 41))


def test_simhash_deduplicate_with_repeated_ids(spark):
    """One row of every text stays, though ids repeat; of equal rows one."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (8, b), (3, a), (None, "alone text here"), (None, "alone text here")]
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, _own_0 string, digest binary").repartition(3)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (None, "alone text here")], key=str)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["u"]: r["root"] for r in components.components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def test_simhash_odd_tables(odd, nothing):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = dict(got)
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == by_id[6] == by_id[None] == 4
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and simhash.deduplicate(nothing).count() == 0


def brute_substrings(docs, window=50):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def planted():
    """Passages of 45 to 130 words, shared whole or in part, inside and across documents, with few and many other words."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = lambda n: [rng.choice("ab") for _ in range(n)]
    passages = [fresh(n) for n in (45, 50, 51, 75, 130)] + [common(60), ["again"] * 70]
    docs = []
    for d in range(60):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 0, 5, 20])
            words += p[cut : len(p) - rng.choice([0, 0, 3])] + fresh(rng.choice([0, 1, 40]))
        docs.append((d * 3 % 61, rng.choice([" ", "\n", "  \t"]).join(words)))
    return docs + [(None, " ".join(passages[4])), (docs[5][0], docs[5][1]), (docs[5][0], docs[6][1]), (99, None), (98, "")]


def test_substrings(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute_substrings(docs)


def test_substring_odd_tables(odd, nothing):
    assert substring_dedup.remove_repeats(odd).count() == odd.count()
    assert substring_dedup.remove_repeats(nothing).count() == 0
    kept = substring_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {**{i: t for i, t in enumerate(ODD)}, None: "the same text"}


def test_substring_deduplicate_leaves_clean_texts_alone(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{passage}  b", 9), (2, passage, 9), (3, f"c {passage} d", 9), (4, "un\ntouched  text", 9)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.deduplicate(docs).collect()}
    assert got == {1: (f"a\n{passage}  b", 9), 3: ("c d", 3), 4: ("un\ntouched  text", 9)}


def test_places_come_from_the_automaton(spark):
    """All documents are streamed; a phrase that the automaton doesn't find gives nothing, whatever else is known of it."""
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(d, f"{' '.join(f'x{d}_{i}' for i in range(d * 7))} {passage} tail{d}", d) for d in range(1, 5)] + [(9, "no phrase " * 60, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key long")
    known = substring_dedup.confirmed(substring_dedup.recurring(substring_dedup.phrases(docs)))
    found = {r["doc_id"]: r["ranges"] for r in substring_dedup.locate(docs, known).collect()}
    assert all(min(x["low"] for x in found[d]) >= d * 7 and max(x["high"] for x in found[d]) <= d * 7 + 300 for d in (2, 3, 4))
    assert not found[1]
    other = known.selectExpr("doc_id", "text_key", "transform(phrases, p -> named_struct('phrase', CAST(concat('q', CAST(p.phrase AS STRING)) AS BINARY), 'reach', p.reach, 'span', p.span, 'first', p.first, 'edge', p.edge)) AS phrases")
    assert substring_dedup.locate(docs, other).count() == 0
    assert substring_dedup.compiled(set()) is None and substring_dedup.occurrences(None, b"a b", None) == []


def test_substring_deduplicate_with_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, "k", "r", 1, "x"), (2, f"a {passage}", "k", "r", 2, None)], "doc_id long, text string, _key string, _ranges string, _own_0 long, text_key string")
    assert sorted(map(tuple, substring_dedup.deduplicate(docs).collect())) == [(1, passage, "k", "r", 1, "x"), (2, "a", "k", "r", 2, None)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 0), (2, 60)]


def test_rows_of_one_id_hold_their_own_phrases(spark):
    """Many texts of one id: each carries what its own text holds, and loses nothing to the others."""
    from codeweave.llm import substring_dedup as sd

    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(30)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(3, passage), (9, passage + " end")], "doc_id long, text string").selectExpr("*", "xxhash64(text) AS text_key")
    known = sd.confirmed(sd.recurring(sd.phrases(docs))).collect()
    assert max(len(r["phrases"]) for r in known) < 30 and sum(r["doc_id"] == 7 for r in known) == 30
    got = {(r["doc_id"], r["n_removed"]) for r in sd.remove_repeats(docs).collect()}
    assert got == {(7, 60), (3, 0), (9, 60)}


def test_parts_are_cut_by_bytes():
    import pyarrow as pa

    from codeweave.llm.common import parts_of

    texts = ["a" * 40, None, "", "b" * 70, "c" * 500, "d" * 60, "e" * 50]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    assert [p.column("text").to_pylist() for p in parts_of(batch, "text", 100)] == [texts[:3], [texts[3]], [texts[4]], [texts[5]], [texts[6]]]
    assert list(parts_of(batch.slice(0, 0), "text", 100)) == []

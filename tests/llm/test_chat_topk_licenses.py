import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave.llm import chat, licenses, topk

PARTS = st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "\\", "[", "<", "]", ">", " ", "\n", "a", "é", "漢", "INST]", "s>"])
TEXT = st.lists(PARTS, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "a]b\\", "other"]), TEXT), min_size=1, max_size=5))
def test_every_conversation_comes_back(turns):
    out, bounds, start, end = chat.assemble([r for r, _ in turns], pa.array([t for _, t in turns]))
    formatted = out.tobytes().decode()
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(out[s:e].tobytes().decode()) for s, e in zip(start, end)] == [t for _, t in turns]
    assert bounds[-1] == len(out)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_over_many_partitions(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["</s>[INST] ok [/INST]", "hé", "", None, "x" * 50])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(-5, t, "assistant" if t % 2 else "user", f"turn {t} [INST]") for t in range(3000)]  # most of all rows
    rows += [(None, None, None, None), (None, 1, "tool", "x"), (3, 0, "user", "again"), (3, 0, "user", "again")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}
        fragments = chat.format_conversations(df).orderBy("part").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_conv = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c, t, r, x in sorted(rows, key=lambda r: (low(r[1]), r[2] or "", r[3] is not None, r[3] or "")):
        by_conv.setdefault(c, []).append((r or "", x or ""))
    assert got == {c: digest(turns) for c, turns in by_conv.items()}
    assert len({f["part"] for f in fragments if f["conv_id"] == -5}) > 1  # the long one is spread
    assert [x for f in fragments if f["conv_id"] == -5 for x in chat.read_back(f["formatted"])] == by_conv[-5]
    assert chat.digests(df.limit(0)).count() == 0


def test_conversations_with_long_texts_and_clashing_columns(spark):
    long = "[INST] ünï </s> " * 300_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", None), (2, 0, "tool", long), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "p", "f", 3, b"l") for r in rows], "conv_id long, turn long, role string, text string, part string, formatted string, n_turns long, loss binary")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}
    assert got == {c: digest([(r, x or "") for k, _, r, x in rows if k == c]) for c in (1, 2)}


def brute_top(rows, is_query, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(ok):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def clustered(rng, n=500, dims=12):
    centres = rng.normal(size=(4, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 4] * 0.3 + rng.normal(size=dims) * 0.1]) for i in range(n)]


@pytest.mark.parametrize("group_bytes", [400, topk.GROUP_BYTES])
def test_top_k(spark, group_bytes):
    rows = clustered(np.random.default_rng(1))
    rows += [(i, rows[3][1]) for i in range(500, 530)]  # ties
    rows += [(50, rows[7][1]), (50, rows[50][1]), (7, rows[50][1])]  # ids that repeat
    rows += [(600, None), (601, []), (602, [None] * 12), (603, [float("nan")] * 12), (604, [float("inf")] * 12), (605, [1.0] * 5), (650, [1.0] * 5), (None, rows[0][1]), (700, [0.0] * 12)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, query_id string, score double").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, group_bytes=group_bytes).collect())
    assert got == brute_top(rows, lambda i: i % 50 == 0, 5)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0
    assert topk.top_k(df.where("vec_id < 3"), F.lit(True), k=5).count() == 6  # fewer than k


def test_top_k_of_very_large_components(spark):
    """Sums beyond 2^53 are exact; those beyond a long are cut to its ends, where smaller ids come first."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 10.0 ** (5 + i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()) == brute_top(rows, lambda i: i % 10 == 0, 5)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [2e30])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(huge, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 6), st.integers(1, 7))
def test_bounds_hold_while_lists_are_read(seed, n, dims, queries):
    rng = np.random.default_rng(seed)
    block, q = rng.integers(-9, 9, (n, dims)).astype(float), rng.integers(-9, 9, (queries, dims)).astype(float)
    lists = topk.Lists(block)
    for depth in (0, n // 9, n // 3, n):
        lists.read(depth)
        lower, upper = lists.bounds(np.maximum(q, 0), np.minimum(q, 0))
        assert (lower <= q @ block.T).all() and (q @ block.T <= upper).all()
    assert (lower == upper).all()


def test_reading_stops_early_where_vectors_have_structure():
    """Queries leave most list entries of clustered vectors unread; results are those of a full scan, also where all is read."""
    rng = np.random.default_rng(3)
    centres = np.round(rng.normal(size=(40, 24)) * 200)
    structured = np.repeat(centres, 500, axis=0) + rng.integers(-9, 9, (20_000, 24))
    loose = rng.integers(-200, 200, (4000, 24)).astype(float)
    for x, share in ((structured[rng.permutation(len(structured))], 0.25), (loose, 1.0)):
        rows = np.arange(len(x))
        search = topk.Search(rows[::500], rows[::500], x[::500], 5)
        for i in range(0, len(x), 10_000):
            search.add(x[i : i + 10_000], rows[i : i + 10_000], rows[i : i + 10_000])
        assert search.reads <= share * search.entries
        scores = x[::500] @ x.T
        scores[np.arange(len(scores)), rows[::500]] = -np.inf
        expected = [sorted(zip((-s).tolist(), rows.tolist()))[:5] for s in scores]
        assert [[(-s, i) for s, i in zip(ss, ii)] for ss, ii in zip(search.best.score.tolist(), search.best.id.tolist())] == expected


def test_licenses_found_whole_changed_and_not_at_all(spark, odd, nothing):
    t = licenses.TEMPLATES
    texts = {
        1: "Words before. Licensed under the Apache License, Version 2.0. Words after.",
        2: "x " * 900 + t["MIT-text"] + " y" * 900,
        3: t["BSD"].replace("source and binary", "source or binary").upper(),
        4: "A text about the license of a driver, released under pressure.",
        5: f"{t['MIT']}. {t['CC-BY-NC-4.0']}. {t['MIT']}.",
        6: " ".join(t["GPL-header"].split()[:12]),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in licenses.license_matches(df).collect():
        got.setdefault(r["doc_id"], []).append((r["char_start"], r["license"], round(r["coverage"], 2), texts[r["doc_id"]][r["char_start"] : r["char_end"]]))
    assert [m[1:] for m in got[1]] == [("Apache-2.0", 1.0, "Licensed under the Apache License, Version 2.0")]
    assert [m[1:3] for m in got[2]] == [("MIT-text", 1.0)]
    assert got[3][0][1] == "BSD" and 0.9 < got[3][0][2] < 1
    assert 4 not in got and 6 not in got
    assert [m[1] for m in sorted(got[5])] == ["MIT", "CC-BY-NC-4.0", "MIT"]
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(nothing).count() == 0


def test_licenses_against_a_scan_for_each_template(spark):
    """Every verbatim occurrence of a short notice in the documents is reported."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs).collect()}
    for name in ("MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"):
        verbatim = {r["doc_id"] for r in docs.where(F.contains(F.lower("text"), F.lit(licenses.TEMPLATES[name].lower()))).collect()}
        assert verbatim and verbatim <= {d for d, n in found if n.startswith(name)}


def test_the_bare_line_of_all_rights_reserved(spark):
    """The short line is a template of its own; where the long notice stands, that is reported."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"] for r in licenses.license_matches(docs).collect() if r["license"].startswith("All-rights-reserved")}
    verbatim = {r["doc_id"] for r in docs.where(F.contains(F.lower("text"), F.lit("all rights reserved"))).collect()}
    assert verbatim and verbatim <= found
    texts = [(1, "Words. All rights reserved. More"), (2, licenses.TEMPLATES["All-rights-reserved-notice"]), (3, "all rights are reserved")]
    got = [(r["doc_id"], r["license"]) for r in licenses.license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "All-rights-reserved"), (2, "All-rights-reserved-notice")]


def brute_coverage(template, words):
    """The best share of a template's words that any local alignment with the text matches, by the whole table."""
    best = (0, 0)
    before = [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words, 1):
            score, matched = before[j - 1]
            options = [(score + 2, matched + 1) if t == w else (score - 1, matched), (before[j][0] - 1, before[j][1]), (row[j - 1][0] - 1, row[j - 1][1])]
            row.append(max((o if o[0] > 0 else (0, 0)) for o in options))
        best = max(best, *row)
        before = row
    return best[1] / len(template)


def test_matches_against_whole_alignments():
    """Templates with words changed, left out or put in: what covers 0.8 or more and keeps a run of words is found, nothing else is."""
    rng = random.Random(6)
    index = licenses.Index(licenses.TEMPLATES)
    plain = [f"w{i}" for i in range(50)] + ["the", "license", "of", "and", "software"]
    found = missed = 0
    for _ in range(400):
        name = rng.choice(list(licenses.TEMPLATES))
        words = list(index.words[name])
        for _ in range(rng.randrange(1 + len(words) // 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["w1"], [], [words[at], "w2"]])
            words = words or ["w3"]
        text = rng.choices(plain, k=rng.randrange(20)) + words + rng.choices(plain, k=rng.randrange(20))
        got = licenses.scan(" ".join(text), index)
        covered = {n: brute_coverage(t, text) for n, t in index.words.items()}
        assert all(covered[n] >= 0.8 and covered[n] >= share for n, share, _, _ in got)
        run = 3 if len(index.words[name]) <= licenses.SHORT else 5
        grams = {tuple(index.words[name][i : i + run]) for i in range(len(index.words[name]) - run + 1)}
        if covered[name] >= 0.8 and any(tuple(text[i : i + run]) in grams for i in range(len(text))):
            found += bool(got)
            missed += not got
    assert found > 100 and missed <= 0.02 * found  # an alignment that leaves the band


def test_a_text_full_of_notices_takes_time_in_proportion():
    index = licenses.Index(licenses.TEMPLATES)
    seconds = []
    for n in (500, 8000):
        text = " and then ".join([licenses.TEMPLATES["MIT"], licenses.TEMPLATES["CC-BY-NC-4.0"]] * n)
        began = time.process_time()
        assert len(licenses.scan(text, index)) == 2 * n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.02)

import base64
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeweave.llm import bpe, packing
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(5)
    alphabet = list("aaabcdeé ñ  \n\t'sre1234!?$#ß漢字ー　\u0085\x1c​") + ["<|endoftext|>", " the", "'ll", "  "]
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)] + [t or "" for t in ODD]


def encoded(codec, texts):
    ids, bounds = codec.encode_batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ranks_encode_as_the_rank_library_does():
    texts = samples()
    assert encoded(bpe.codec(RANKS), texts) == reference().encode_ordinary_batch(texts)


def test_every_kind_of_character():
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(0, 0x11000, 3) if not 0xD800 <= c < 0xE000]
    assert encoded(bpe.codec(RANKS), texts) == reference().encode_ordinary_batch(texts)


def test_json_vocabulary_encodes_as_the_library_does():
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    texts = samples()
    assert encoded(bpe.codec(JSON), texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_small_memo_changes_nothing():
    texts = samples()
    small = bpe.Codec(RANKS, memo_entries=50)
    assert [r for i in range(0, len(texts), 40) for r in encoded(small, texts[i : i + 40])] == encoded(bpe.codec(RANKS), texts)


def test_round_trip_and_spans(spark, odd, nothing):
    rows = bpe.round_trip(odd, RANKS).collect()
    assert len(rows) == odd.count() and bpe.round_trip(nothing, RANKS).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    for r in bpe.encode(odd.where("doc_id = 7"), RANKS).collect():
        text = ODD[7]
        assert r["char_start"][0] == 0 and r["char_end"][-1] == len(text)
        assert all(a < b for a, b in zip(r["char_start"], r["char_end"]))  # a split character belongs to each of its tokens


def pieces_of(rows):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    return docs, sequences


def test_packing_loses_nothing_and_pads_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")
    rows = packing.pack(docs, JSON).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_doc, sequences = pieces_of(rows)
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        got = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [x for r in got for x in np.frombuffer(r["ids"], "<u4")] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
        assert [r["start"] for r in got] == [sum(p["length"] for p in got[:i]) for i in range(len(got))]
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        total = sum(r["length"] for r in pieces)
        assert total <= 1024 and total & (total - 1) == 0  # full, or a power of two: no padding


def test_placing_follows_the_sum_of_squares():
    def brute(counts, size, window):
        change = {0: 2 * counts[size] + 1 if size < window else 0}
        for h in range(1, window - size + 1):
            if counts[h]:
                change[h] = 1 - 2 * counts[h] if h + size == window else 2 * (counts[h + size] - counts[h]) + 2
        return min(change.values())

    rng = random.Random(2)
    p = packing.Packer(64, 0)
    for i in range(2000):
        size = rng.choice([5, 7, 20, 31, 33, 40, 63])
        before = p.counts.copy()
        squares = int((before**2).sum())
        best = brute(before, size, 64)
        p.add(i, b"\1\0\0\0" * size)
        assert int((p.counts**2).sum()) - squares == best
    p.finish()
    assert sum(r[2] for r in p.take()) > 0 and not p.counts.any()


def test_packing_odd_tables(odd, nothing):
    rows = packing.pack(odd, JSON, with_ids=False).collect()
    assert packing.pack(nothing, JSON).count() == 0
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == 2  # null and empty: the closing id each
    total = {(r["doc_id"], r["start"]) for r in rows}
    assert {d for d, _ in total} == {None, *range(len(ODD))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=300), st.integers(1, 90))
def test_few_open_windows_lose_nothing_and_pad_nothing(sizes, most):
    """Every id of every document, in order, whatever is filled up early; only the last windows aren't full."""
    packer = packing.Packer(64, 0, max_open=most)
    docs = [np.arange(i * 1000, i * 1000 + n, dtype="<u4").tobytes() for i, n in enumerate(sizes)]
    for i, ids in enumerate(docs):
        packer.add(i, ids)
        assert packer.n_open <= max(most, 64) and packer.n_open == packer.counts.sum() == sum(map(len, packer.at))
    packer.finish()
    rows = packer.take()
    for i, ids in enumerate(docs):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        assert b"".join(r[7] for r in own) == ids and all(r[3] == zlib.crc32(r[7]) and r[2] == len(r[7]) // 4 for r in own)
        assert [r[1] for r in own] == [sum(p[2] for p in own[:k]) for k in range(len(own))]
    full = {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        assert r[6] == full.get(r[5], 0)
        full[r[5]] = r[6] + r[2]
    rest = [n for n in full.values() if n != 64]
    assert all(n & (n - 1) == 0 and n < 64 for n in rest) and len(set(rest)) == len(rest)


def test_most_windows_are_closed_by_the_method():
    """Of a partition of 2,000 documents, at most a fifth of the windows are touched when it ends."""
    rng = random.Random(8)
    packer = packing.Packer(1024, 0)
    for i in range(2000):
        packer.add(i, b"\1\0\0\0" * int(rng.lognormvariate(5.5, 1)))
    before = len({r[5] for r in packer.take()})
    packer.finish()
    assert len({r[5] for r in packer.take()}) <= 0.2 * before


def test_a_tokenizer_that_cuts_otherwise_is_refused(tmp_path):
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}):
        path = tmp_path / "own.json"
        with open(JSON, encoding="utf-8") as f:
            path.write_text(json.dumps(json.load(f) | change))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Codec(str(path))

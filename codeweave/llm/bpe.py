"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary is either a tokenizers JSON file or a file of base64 ranks; from ranks the merges are
rebuilt: every way to split a token into two tokens becomes a merge, ordered by the token's rank,
which is the choice that a rank-based encoder makes. Text is cut into units between words; each
worker keeps a bounded memo of unit -> ids, so the library encodes each distinct unit once, not
each occurrence; words, ids and bounds stay in Arrow and numpy buffers.

Defined cases: null text counts as empty and has no ids; special-token strings in a text are
ordinary text; other columns of the input are ignored; rows with equal ids are each encoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from codeweave.llm.common import batch_of, cleaners, run_indices, space_units, task, texts_of

#: Most entries that a worker's memo holds before it keeps those of one batch only, and most rows that are encoded at once.
MEMO_ENTRIES = 500_000
ROWS = 2000

#: A blank at the start, or after white space of any kind.
_NOT_PLAIN = r"^ |[\s\x0b\x1c-\x1f\x{85}\pZ] "


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    spare = (chr(0x100 + i) for i in range(256))
    return [table[b] if b in table else next(spare) for b in range(256)]


def _from_ranks(path: str):
    from public_tokenizers import PATTERN
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    chars = byte_alphabet()
    name = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    own = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    own.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return own


def _from_json(path: str):
    """The tokenizer of a file; only one that cuts as ``PATTERN`` does and changes no text fits what is memoised here."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or made.get("normalizer") or made["model"].get("type") != "BPE" or made["model"].get("dropout"):
        raise ValueError(f"{path}: only byte-level BPE with the usual pattern, without a normalizer, is supported")
    return Tokenizer.from_file(path)


#: Signs that may end a word.
_ENDS = frozenset(".,;:!?)")


class Codec:
    """A byte-level tokenizer with its byte table; made once in each worker (see :func:`codec`)."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        from public_tokenizers import PATTERN

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = _from_json(path) if path.endswith(".json") else _from_ranks(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes: list[bytes] = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.token_length = np.array([len(t) for t in self.token_bytes], np.int64)
        self._names = dict(enumerate(byte_alphabet()))
        self._matches = regex.compile(PATTERN).findall
        self._memo: dict[str, bytes] = {}  # a word after one blank -> ids
        self._most = memo_entries

    def encode_bytes(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill(self, words: list[str]) -> None:
        """Memo entries for words after a blank: cut by the pattern, each distinct match merged by the library's model.

        A word of letters is one match with its blank, and a sign of ``_ENDS`` after letters one of its own, so these need no pattern.
        """
        memo, merged, tokenize, names = self._memo, {}, self.tokenizer.model.tokenize, self._names
        blank = names[0x20]

        def ids(match: str) -> bytes:
            found = merged.get(match)
            if found is None:
                merged[match] = found = array("I", [t.id for t in tokenize(match.encode().decode("latin-1").translate(names))]).tobytes()
            return found

        def ids_of(letters: str) -> bytes:
            if not letters.isascii():
                return ids(" " + letters)
            return array("I", [t.id for t in tokenize(blank + letters)]).tobytes()

        for w in words:
            if w.isalpha():
                memo[w] = ids_of(w)
            elif w[-1:] in _ENDS and w[:-1].isalpha():
                memo[w] = (memo.get(w[:-1]) or ids_of(w[:-1])) + ids(w[-1])
            else:
                memo[w] = b"".join(map(ids, self._matches(" " + w)))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and the bounds of each text's ids."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
        bounds = bounds - bounds[0]
        codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        memo = self._memo
        if len(memo) > self._most:  # frequent words are in every batch
            self._memo = memo = {w: memo[w] for w in words if w in memo}
        self._fill([w for w in words if w not in memo])
        pieces = list(map(memo.__getitem__, words))
        # the first word of a text follows no blank, and texts with runs of white space are encoded by other cuts
        keep = np.ones(len(codes), bool)
        first = bounds[:-1]
        for row in np.flatnonzero(odd).tolist():
            keep[bounds[row] + 1 : bounds[row + 1]] = False
        codes[first] = len(pieces) + np.arange(len(first))
        heads = [t if o else w for t, w, o in zip(texts.to_pylist(), lists.values.take(pa.array(first + lists.offsets[0].as_py())).to_pylist(), odd)]
        for h, o in zip(heads, odd):
            pieces.append(self._encode_odd(h) if o else self.encode_bytes(h) if h else b"")
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(pieces), "<u4")
        of_unit = size[codes] * keep
        ids = flat[run_indices(start[codes], of_unit)]
        upto = np.concatenate(([0], np.cumsum(of_unit)))
        return ids, upto[bounds]

    def _encode_odd(self, text: str) -> bytes:
        units = space_units(text)
        memo = self._memo
        self._fill(list({u for u in units[1] if u not in memo}))
        return self.encode_bytes(units[0]) + b"".join(map(memo.__getitem__, units[1]))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes that the ids stand for; a character split over tokens comes together again."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def encoded(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
        """doc_id, text and ids of a batch, in slices."""
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            ids, bounds = self.encode_batch(part.column("text"))
            yield part.column("doc_id"), part.column("text"), [ids[s:e] for s, e in zip(bounds.tolist(), bounds[1:].tolist())]

    def spans(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start of each token, and the first and last+1 character that it touches."""
        end = np.cumsum(self.token_length[ids])
        start = end - self.token_length[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        return start, char_of_byte[start], char_of_byte[end - 1] + 1


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


cleaners.append(codec.cache_clear)

ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("char_start", pa.list_(pa.int64())), ("char_end", pa.list_(pa.int64()))]
)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and for each id the first and last+1 character of the text that it touches."""

    @task("bpe")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for doc_id, text, rows in c.encoded(b):
                spans = [c.spans(i, t) for i, t in zip(rows, texts_of(text))]
                yield batch_of(ENCODED, doc_id, [i.astype(np.int64) for i in rows], [s[1] for s in spans], [s[2] for s in spans])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<long>, char_start array<long>, char_end array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of ``ids``; null ids give an empty text, bytes that are no UTF-8 a replacement character."""

    @task("bpe")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [np.array(i or [], np.int64) for i in b.column("ids").to_pylist()]
            yield batch_of(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), b.column("doc_id"), [c.decode(i).decode("utf-8", "replace") for i in ids])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, and decoded from those ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @task("bpe")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches:
            for doc_id, _, rows in c.encoded(b):
                yield batch_of(schema, doc_id, list(map(len, rows)), [sha(i.tobytes()).hexdigest() for i in rows], [sha(c.decode(i)).hexdigest() for i in rows])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

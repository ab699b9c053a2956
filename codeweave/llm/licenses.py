"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Templates are short public notices and the openings of common licence texts (a parameter). Their words
are hashed in 3-word fingerprints, winnowed over 3 neighbours (templates of up to ``SHORT`` words keep all), and
kept in an inverted index of hash -> (template, place); its size is that of the templates. Every document's
3-word hashes, all of them, are looked up in it. So a candidate needs five words in a row as they stand in the
template, three for a short one. Hits of one template whose diagonals lie close together make a candidate, and a banded
alignment (match 2, other -1) of the template against the text around it gives the matched words, their
share of the template (``coverage``) and the span in the text. Matches with a coverage of 0.8 or more are
reported, the best of overlapping ones. Hits are sorted once and matches kept in order, so a text full of
notices takes time in proportion (and the logarithm of their number).

Words are runs of letters and digits, compared in lower case. A document is scanned in its own task; no
shuffle.

Defined cases: null and empty texts have no matches and give no rows; a template found at several places
gives a row each; a null doc_id is returned as it is; repeated rows give repeated matches; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from codeweave.llm.common import batch_of, task

GRAM = 3
WINNOW = 3
SHORT = 12
WORD = re.compile(r"[^\W_]+")

# Public licence notices and the openings of licence texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All-rights-reserved": "All rights reserved",
    "All-rights-reserved-notice": "All rights reserved. No part of this publication may be reproduced",
}

_MASK = (1 << 61) - 1


def _hash(word: str) -> int:
    h = 0
    for c in word.encode():
        h = (h * 1_000_003 + c + 1) & _MASK
    return h


def _grams(hashes: list[int]) -> list[int]:
    return [(a * 31 + b * 17 + c) & _MASK for a, b, c in zip(hashes, hashes[1:], hashes[2:])]


class Index:
    """Inverted index of the winnowed fingerprints of all templates."""

    def __init__(self, templates: dict[str, str]):
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in templates.items()}
        self.vocabulary = {w: _hash(w) for words in self.words.values() for w in words}
        self.places: dict[int, list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            grams = _grams([self.vocabulary[w] for w in words])
            width = WINNOW if len(words) > SHORT else 1
            last = -1
            for i in range(max(1, len(grams) - width + 1) if grams else 0):
                window = grams[i : i + width]
                at = i + min(range(len(window)), key=lambda j: (window[j], -j))
                if at != last:
                    self.places.setdefault(grams[at], []).append((name, at))
                last = at

    def hits(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(template, place in it, place in the text) of every shared fingerprint; only words of templates are hashed."""
        get = self.vocabulary.get
        known = [(i, h) for i, h in enumerate(map(get, words)) if h is not None]
        found = []
        for (i, a), (j, b), (k, c) in zip(known, known[1:], known[2:]):
            if k - i == 2:
                for name, at in self.places.get((a * 31 + b * 17 + c) & _MASK, ()):
                    found.append((name, at, i))
        return found


def align(template: list[str], words: list[str], low: int, high: int, diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched words, and first and last+1 word of the text, of the best local alignment near a diagonal."""
    best, before = (0, 0, 0, 0), {}
    for i, t in enumerate(template):
        row = {}
        for j in range(max(low, i + diagonal - band), min(high, i + diagonal + band + 1)):
            score, matched, start = before.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, start = 0, 0, j
            options = [(score + 2, matched + 1, start) if t == words[j] else (score - 1, matched, start)]
            if j in before:
                options.append((before[j][0] - 1, *before[j][1:]))
            if j - 1 in row:
                options.append((row[j - 1][0] - 1, *row[j - 1][1:]))
            row[j] = max(options, key=lambda o: o[:2])
            if row[j][0] > best[0]:
                best = (row[j][0], row[j][1], row[j][2], j + 1)
        before = row
    return best[1:]


def scan(text: str, index: Index, coverage: float = 0.8) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first and last+1 character) of every match in a text."""
    found = list(WORD.finditer(text))
    words = [m[0].lower() for m in found]
    groups: dict[str, list[tuple[int, int]]] = {}
    for name, at, place in index.hits(words):
        groups.setdefault(name, []).append((place - at, place))
    matches = []
    for name, hits in groups.items():
        template = index.words[name]
        band = max(2, len(template) // 8)
        hits.sort()
        at = 0
        while at < len(hits):
            diagonal = hits[at][0]
            after = bisect_right(hits, (diagonal + band, len(words)), at)
            middle = hits[(at + after) // 2][0]
            matched, s, e = align(template, words, max(0, middle - band), min(len(words), middle + len(template) + band), middle, band)
            if matched >= coverage * len(template):
                matches.append((matched / len(template), matched, name, s, e))
            at = after
    starts: list[int] = []  # of the matches taken, which don't overlap
    taken: dict[int, tuple[str, float, int, int]] = {}
    for share, matched, name, s, e in sorted(matches, key=lambda m: (-m[1], -m[0], m[2], m[3])):
        k = bisect_left(starts, e)
        if not k or taken[starts[k - 1]][3] <= s:
            starts.insert(bisect_left(starts, s), s)
            taken[s] = (name, share, s, e)
    return [(name, share, found[s].start(), found[e - 1].end()) for name, share, s, e in map(taken.__getitem__, starts)]


@lru_cache(2)
def _index(templates: tuple) -> Index:
    return Index(dict(templates))


MATCHES = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("char_start", pa.int64()), ("char_end", pa.int64())])


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, char_start and char_end of every template found in ``docs``."""
    items = tuple((templates or TEMPLATES).items())

    @task("licenses")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for m in scan(t.as_py() or "", index, coverage)]
            yield batch_of(MATCHES, *(zip(*rows) if rows else ([],) * 5))

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, license string, coverage double, char_start long, char_end long")

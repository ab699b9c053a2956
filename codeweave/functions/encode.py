"""Text vectors without a model: signed feature hashing of sub-words and of what they are about, to unit length.

Words of one concept share a feature, so that a query finds names that say the same in other words. Any callable from a list of texts to a matrix can take its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


# Words that programs use for the same thing; a line a concept.
CONCEPTS = """
authenticate auth login signin logon sign credentials password session identity
authorize permission allow grant access role privilege
logout signout logoff
encrypt cipher hash digest secret crypt
open connect connection attach link socket
close shut disconnect detach finish release dispose
get fetch load read retrieve obtain lookup
set put store save write persist keep
find search query seek locate match
remove delete erase drop clear purge discard unlink
add append insert push attach enqueue register
create make build new construct generate spawn
update modify change edit alter patch refresh
copy clone duplicate replicate
move rename transfer migrate
parse decode scan tokenize interpret deserialize unmarshal
format encode render serialize marshal stringify print
convert transform translate map cast
check validate verify test assert ensure
count size length number total amount
sum add total aggregate accumulate
sort order rank arrange
filter select choose pick
join merge combine concat concatenate union
split divide separate partition chunk
start begin launch run execute invoke call
stop end halt terminate abort cancel kill
wait sleep delay pause block
retry repeat again loop iterate
send post emit publish dispatch transmit
receive accept consume listen subscribe handle
request response http url endpoint route api
error exception failure fault problem
log trace debug record report audit
file path folder directory document
database db sql table store repository
cache memo buffer pool
user account member person customer
price cost fare fee charge payment money amount
time date clock timestamp day
first begin head front
last end tail back
"""
_CONCEPTS: dict[str, list[str]] = {}
for _line in CONCEPTS.split("\n"):
    for _word in _line.split():
        _CONCEPTS.setdefault(_word, []).append(f"={_line.split()[0]}")


def _stems(word: str) -> list[str]:
    """The word, and what is left without an ending."""
    return [word, *(word[: -len(e)] + add for e in ("s", "es", "ed", "ing", "er", "or") for add in ("", "e") if word.endswith(e) and len(word) - len(e) >= 3)]


def parts(text: str) -> list[str]:
    """Sub-words of identifiers and prose, lower-cased, with their first letters as weaker evidence of kinship, and their concepts."""
    words = [p.lower() for p in _PART.findall(text)]
    about = [c for w in words for c in dict.fromkeys(c for s in _stems(w) for c in _CONCEPTS.get(s, ()))]
    return [*words, *(f"{w[:4]}*" for w in words if len(w) > 4), *about]


def encode(texts: list[str]) -> np.ndarray:
    """float32 rows of length 1; a text without words is a zero row."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        for p in parts(text or ""):
            h = zlib.crc32(p.encode())
            row[h % DIMENSIONS] += 1.0 if h >> 31 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    size[size == 0] = 1
    return out / size


def encode_query(text: str) -> list[float]:
    return encode([text])[0].tolist()


def text_of_symbol() -> Column:
    """Name, signature and comment, as far as there are any."""
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("name", "signature", "doc")])


def encode_symbols(symbols: DataFrame) -> DataFrame:
    """(id, embedding) from name, signature and comment."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(texts.tolist())))

    return symbols.select("id", vectors(text_of_symbol()).alias("embedding"))

"""The tables of a code graph. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: A stored graph with another version is built anew; the extract version is part of every cache key.
SCHEMA_VERSION = 3
EXTRACT_VERSION = 2

FILES = "path string, lang string, hash string"
SYMBOLS = (
    "id string, name string, kind string, path string, lang string, line_start bigint, line_end bigint, start_byte bigint, "
    "end_byte bigint, signature string, doc string, visibility string, modifiers string, rank double"
)
CALLS = "src string, dst string, confidence string, line bigint"
USES = INHERITS = "src string, dst string, confidence string"
CONTAINS = "src string, dst string"
IMPORTS = "src_path string, dst_path string"
EMBEDDINGS = "id string, embedding array<float>"
GRAMS = "gram string, id string, bucket int"
LATENT = "token string, share double, vector array<double>"

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "calls": CALLS, "uses": USES, "inherits": INHERITS, "contains": CONTAINS,
    "imports": IMPORTS, "embeddings": EMBEDDINGS, "name_grams": GRAMS, "doc_grams": GRAMS, "latent": LATENT,
}

#: References as extracted, with their file; kept for the next build.
RAW = {
    "callsites": "path string, src string, name string, line bigint", "bases": "path string, src string, name string", "type_refs": "path string, src string, name string",
    "raw_imports": "path string, raw string", "holds": "path string, src string, dst string",
}

# Kinds, confidence tiers and the two sets of type kinds.
EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
ENCLOSING_TYPES = ("class", "interface", "trait", "enum", "struct")
RESOLVED_TYPES = (*ENCLOSING_TYPES, "type")
MAPPED_KINDS = ("function", "method", "class", "interface", "struct", "enum", "trait")
SYMBOL_EDGES = ("CALLS", "USES", "INHERITS")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


@dataclass
class Graph:
    """The DataFrames of one graph; all lazy."""

    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    uses: DataFrame
    inherits: DataFrame
    contains: DataFrame
    imports: DataFrame
    embeddings: DataFrame | None = None
    #: Posting indexes of names and comments for substring search.
    name_grams: DataFrame | None = None
    doc_grams: DataFrame | None = None
    #: What the embeddings were learned as; empty where they are hashed.
    latent: DataFrame | None = None

    def edges(self, kind: str) -> DataFrame:
        return {"CALLS": self.calls, "USES": self.uses, "INHERITS": self.inherits, "CONTAINS": self.contains}[kind]

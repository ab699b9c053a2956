"""Column expressions over paths, names and source text; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".lua": "lua", ".sh": "bash", ".bash": "bash", ".sql": "sql",
}


def language_of(path: Column) -> Column:
    """The language of a path by its lower-cased last suffix, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    suffix = F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))
    return F.try_element_at(table, suffix)


def location(path: Column, line: Column, end: Column | None = None) -> Column:
    at = F.concat(path, F.lit(":"), line.cast("string"))
    return at if end is None else F.concat(at, F.lit("-"), end.cast("string"))


def module_of(path: Column) -> Column:
    """The first directory of a path, or the path itself."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(path)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def stem_of(path: Column) -> Column:
    return without_extension(F.substring_index(path, "/", -1))


def compact(*columns: Column) -> Column:
    """Tab-joined display row; a missing value prints as None."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns])


def slug_of(path: Column) -> Column:
    """Directory name of a project: its cleaned base name and ten digits of the path's SHA-1."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"[^A-Za-z0-9_.-]", "-")
    return F.concat(F.when(base == "", "repo").otherwise(base), F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 10))


def cache_key(path: Column, digest: Column, version: int) -> Column:
    return F.sha1(F.concat(F.lit(f"v{version}:"), path, F.lit("@"), digest).cast("binary"))


def body_of(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a file as text; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.substring(content, start.cast("int") + 1, (end - start).cast("int")).cast("string"))


def normalised_path(path: Column) -> Column:
    """``a/./b/../c`` -> ``a/c``; parts above the root stay as ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")

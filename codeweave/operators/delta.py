"""Edges after an edit: only references that the edit may settle anew are resolved, the others keep their edges.

A reference's edges follow from the symbols of its name, from its own file, and for calls from the imports of its file. So
an edit of some files touches the references in these files, those in files whose imports changed, and those to a name
that a symbol of these files has or had. An edge's name is the name of the symbol that it ends at, so old edges
are sorted into touched and kept ones by the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.operators import resolve


def replaced(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of ``old`` whose path isn't ``changed``, and those of ``new``."""
    return old.join(changed, "path", "left_anti").select(*new.columns).unionByName(new)


def names_of(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    return symbols.join(changed, "path", "left_semi").select("name").distinct()


def import_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path) of files that import other files than before."""
    pair = ["src_path", "dst_path"]
    return old.join(new, pair, "left_anti").select(*pair).unionByName(new.join(old, pair, "left_anti").select(*pair)).select(F.col("src_path").alias("path")).distinct()


def touched(refs: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of ``refs`` (path, src, name, ...) to one of the names or in one of the files."""
    marked = refs.join(names.withColumn("_n", F.lit(True)), "name", "left").join(paths.withColumn("_p", F.lit(True)), "path", "left")
    return marked.where("_n OR _p").select(*refs.columns)


def kept(edges: DataFrame, old_symbols: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """The old edges that none of this touches."""
    ends = edges.join(old_symbols.select(F.col("id").alias("src"), "path"), "src").join(old_symbols.select(F.col("id").alias("dst"), "name"), "dst")
    return ends.join(names, "name", "left_anti").join(paths, "path", "left_anti").select(*edges.columns)


def edges_after(kind: str, old_edges: DataFrame, old_symbols: DataFrame, refs: DataFrame, symbols: DataFrame, names: DataFrame, paths: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """CALLS, INHERITS or USES edges of ``refs``: what a full resolution of all of them gives.

    ``names`` are those of symbols that came, went or moved; ``paths`` the files whose references count anew. Candidates are
    looked up for the names of touched references alone.
    """
    again = touched(refs, names, paths)
    some = symbols.join(again.select("name").distinct(), "name", "left_semi").unionByName(symbols.join(again.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(*symbols.columns)).dropDuplicates(["id"])
    # symbols that are here only as sources have names that no touched reference has, so they are nobody's candidates
    if kind == "CALLS":
        new = resolve.resolve_calls(again.select("src", "name", "line"), some, imports)
    elif kind == "INHERITS":
        new = resolve.resolve_inherits(again.select("src", "name"), some)
    else:
        new = resolve.resolve_uses(again.select("src", "name"), some)
    return kept(old_edges, old_symbols, names, paths).unionByName(new.select(*old_edges.columns))

"""Manifests, caches and upserts: joins on keys, no row-by-row state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.functions.text import cache_key
from codeweave.schema import EXTRACT_VERSION, Graph


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of every path in either manifest (path, hash): added, changed, removed or same."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    both = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def unchanged(old: DataFrame, new: DataFrame) -> bool:
    return manifest_diff(old, new).where("status <> 'same'").isEmpty()


def cache_misses(files: DataFrame, extracts: DataFrame, version: int = EXTRACT_VERSION) -> DataFrame:
    """Files (path, hash) without an extract under their key."""
    keyed = files.withColumn("cache_key", cache_key(F.col("path"), F.col("hash"), version))
    return keyed.join(extracts.select("cache_key"), "cache_key", "left_anti").select("path", "hash", "cache_key")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key isn't among them."""
    return new.select(*old.columns).unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns))


def delete_file(graph: Graph, path: str) -> Graph:
    """The graph without a file, its symbols and every edge at one of them."""
    gone = graph.symbols.where(F.col("path") == path).select("id")

    def clean(edges: DataFrame) -> DataFrame:
        out = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return out.select(*edges.columns)

    return Graph(
        graph.files.where(F.col("path") != path),
        graph.symbols.where(F.col("path") != path),
        *(clean(e) for e in (graph.calls, graph.uses, graph.inherits, graph.contains)),
        graph.imports.where((F.col("src_path") != path) & (F.col("dst_path") != path)),
        *(t.join(gone, "id", "left_anti").select(*t.columns) if t is not None else None for t in (graph.embeddings, graph.name_grams, graph.doc_grams)),
        graph.latent,
    )


def with_known_ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose both ends are symbols."""
    ids = symbols.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.select(*edges.columns)

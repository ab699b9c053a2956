"""Building a graph from a source tree: hash, extract what changed, resolve, rank, encode, publish."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.functions.encode import encode_query, encode_symbols, text_of_symbol
from codeweave.functions.text import cache_key, language_of
from codeweave.graph import CodeGraph
from codeweave.operators import delta, grams, incremental, latent, rank, resolve
from codeweave.plans.scratch import discard, materialize
from codeweave.schema import EXTRACT_VERSION, FILES, LATENT, RAW, SYMBOLS, TABLES, Graph, struct
from codeweave.sources.catalog import Catalog
from codeweave.sources.extract import extract_files
from codeweave.sources.tree import read_tree


def tables_of(extracts: DataFrame) -> dict[str, DataFrame]:
    """Symbols, and raw references with the file that they are in."""
    within = lambda column, *fields: extracts.select("path", F.explode(column).alias("x")).select("path", *fields)
    return {
        "symbols": extracts.select(F.explode("symbols").alias("s")).select("s.*").dropDuplicates(["id"]).withColumn("rank", F.lit(0.0)).select(*struct(SYMBOLS).names),
        "callsites": within("callsites", F.col("x.caller_id").alias("src"), F.col("x.callee_name").alias("name"), F.col("x.line").alias("line")),
        "bases": within("inherits", F.col("x.sub").alias("src"), F.col("x.base").alias("name")),
        "type_refs": within("uses", "x.src", F.col("x.type_name").alias("name")),
        "raw_imports": within("imports", F.col("x").alias("raw")),
        "holds": within("contains", F.col("x.parent").alias("src"), F.col("x.child").alias("dst")).distinct(),
    }


def graph_of(extracts: DataFrame) -> Graph:
    """The unranked graph of extract rows: exploded symbols and references, resolved."""
    return _resolved(extracts.select("path", "lang", "hash"), tables_of(extracts))


def _imports(files: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    return resolve.resolve_imports(t["raw_imports"].select(F.col("path").alias("src_path"), "raw"), files)


def _resolved(files: DataFrame, t: dict[str, DataFrame]) -> Graph:
    imports = _imports(files, t)
    return Graph(
        files,
        t["symbols"],
        resolve.resolve_calls(t["callsites"].drop("path"), t["symbols"], imports),
        resolve.resolve_uses(t["type_refs"].drop("path"), t["symbols"]),
        resolve.resolve_inherits(t["bases"].drop("path"), t["symbols"]),
        incremental.with_known_ends(t["holds"].select("src", "dst"), t["symbols"]),
        imports,
    )


def _edited(old: Graph, files: DataFrame, t: dict[str, DataFrame], changed: DataFrame) -> Graph:
    """The unranked graph after an edit of the files in ``changed``: what it touches is resolved, the other edges stay."""
    imports = materialize(_imports(files, t))
    names = materialize(delta.names_of(old.symbols, changed).unionByName(delta.names_of(t["symbols"], changed)).distinct())
    paths = materialize(changed.unionByName(delta.import_changes(old.imports, imports)).distinct())
    after = lambda kind, edges, refs: delta.edges_after(kind, edges, old.symbols, t[refs], t["symbols"], names, paths, imports)
    return Graph(
        files,
        t["symbols"],
        after("CALLS", old.calls, "callsites"),
        after("USES", old.uses, "type_refs"),
        after("INHERITS", old.inherits, "bases"),
        incremental.with_known_ends(t["holds"].select("src", "dst"), t["symbols"]),
        imports,
    )


def build_index(spark: SparkSession, root: str, home: str, full: bool = False, embeddings: bool = True, learned: bool | None = None) -> dict[str, int]:
    """Brings the stored graph of a tree up to date and returns its counts.

    If no file changed, nothing is built. Only changed files are extracted, and only references that they touch are resolved (all
    with ``full``); ranks are those of the whole graph. Embeddings are hashed, or with ``learned`` a model of the tree's own
    texts; where that isn't given, as they were before.
    """
    root = os.path.realpath(root)
    catalog = Catalog(spark, home)
    sources = read_tree(spark, root).where(language_of(F.col("path")).isNotNull())
    hashed = sources.withColumn("hash", F.sha1("content")).withColumn("cache_key", cache_key(F.col("path"), F.col("hash"), EXTRACT_VERSION))
    version = catalog.new_version(root)
    found = materialize(hashed.select("path", "hash"))
    meta = catalog.current(root)
    if meta and not full and not learned and incremental.unchanged(catalog.manifest(root), found):
        discard(spark, found)
        return meta["stats"]

    missing = incremental.cache_misses(found, catalog.extracts(root)) if not full else found.withColumn("cache_key", cache_key(F.col("path"), F.col("hash"), EXTRACT_VERSION))
    fresh = materialize(extract_files(hashed.join(missing.select("path"), "path", "left_semi")))
    catalog.add_extracts(root, fresh)
    # a file that was saved after it was hashed goes in as it was extracted
    as_read = fresh.select("path", F.col("hash").alias("as_read"))
    found.join(as_read, "path", "left").select("path", F.coalesce("as_read", "hash").alias("hash")).write.parquet(f"{version}/manifest")
    manifest = spark.read.schema("path string, hash string").parquet(f"{version}/manifest")
    wanted = manifest.withColumn("cache_key", cache_key(F.col("path"), F.col("hash"), EXTRACT_VERSION))

    old = catalog.graph(root) if meta and not full else None
    if old:
        changed = materialize(incremental.manifest_diff(catalog.manifest(root), manifest).where("status <> 'same'").select("path"))
        wanted = wanted.join(changed, "path", "left_semi")
    extracts = materialize(catalog.extracts(root).join(wanted.select("cache_key"), "cache_key", "left_semi").dropDuplicates(["cache_key"]))
    tables, files = tables_of(extracts), extracts.select("path", "lang", "hash")
    if old:
        before = {"symbols": old.symbols.withColumn("rank", F.lit(0.0)), **{name: catalog.table(root, name, ddl) for name, ddl in RAW.items()}}
        tables = {name: delta.replaced(before[name], rows, changed) for name, rows in tables.items()}
        files = delta.replaced(old.files, files, changed)
    files.write.parquet(f"{version}/files")
    for name, ddl in RAW.items():
        tables[name].write.parquet(f"{version}/{name}")
        tables[name] = spark.read.schema(ddl).parquet(f"{version}/{name}")
    tables["symbols"] = materialize(tables["symbols"])
    files = spark.read.schema(FILES).parquet(f"{version}/files")
    g = _edited(old, files, tables, changed) if old else _resolved(files, tables)
    for name in ("calls", "uses", "inherits", "contains", "imports"):
        getattr(g, name).write.parquet(f"{version}/{name}")
        setattr(g, name, spark.read.schema(TABLES[name]).parquet(f"{version}/{name}"))
    ranks = rank.symbol_ranks(g.symbols, g.calls, g.uses, g.inherits)
    g.symbols.drop("rank").join(ranks, "id", "left").fillna(0.0, ["rank"]).write.parquet(f"{version}/symbols")
    g.symbols = spark.read.schema(struct(SYMBOLS)).parquet(f"{version}/symbols")
    for column in ("name", "doc"):
        grams.postings(g.symbols, "id", column).write.partitionBy("bucket").parquet(f"{version}/{column}_grams")
    if embeddings:
        if learned if learned is not None else not catalog.table(root, "latent", LATENT).isEmpty():
            texts = g.symbols.select("id", text_of_symbol().alias("text"))
            latent.fit(texts, "id", "text").write.parquet(f"{version}/latent")
            latent.encode(texts, spark.read.schema(LATENT).parquet(f"{version}/latent"), "id", "text").write.parquet(f"{version}/embeddings")
        else:
            encode_symbols(g.symbols).write.parquet(f"{version}/embeddings")
    stats = {r["label"]: r["n"] for r in CodeGraph(g).stats().collect()}
    catalog.publish(root, version, stats)
    return stats


def open_graph(spark: SparkSession, root: str, home: str) -> CodeGraph | None:
    """The stored graph of a tree with its sources and encoder, or None."""
    root = os.path.realpath(root)
    graph = Catalog(spark, home).graph(root)
    if graph is None:
        return None
    encoder = encode_query if graph.latent.isEmpty() else lambda text: latent.encode_query(graph.latent, text)
    return CodeGraph(graph, read_tree(spark, root), encoder)

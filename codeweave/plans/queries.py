"""One query for each operator of the engine, over the bound star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.functions.text import body_of, language_of, slug_of
from codeweave.graph import CodeGraph
from codeweave.operators import grams, incremental, latent, rank, resolve, similarity
from codeweave.plans import shapes
from codeweave.plans.binding import Binding
from codeweave.plans.cypher import cypher
from codeweave.plans.oracles import PATH_TARGET
from codeweave.plans.scratch import materialize, scratch_dir
from codeweave.schema import GRAMS
from codeweave.sources.extract import extract_facts, extract_files
from codeweave.sources.rules import is_source
from codeweave.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on_graph(name: str, body: Callable[[CodeGraph, Binding], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = Binding(spark, sf_dir)
        return body(CodeGraph(b.graph()), b)

    run.__name__ = name
    QUERIES[name] = run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path3(b: Binding) -> str:
    return b.id_of(3).split("#")[0]


on_graph("search_symbols", lambda g, b: g.search_symbols("widget"))
on_graph("search_symbols_kind", lambda g, b: g.search_symbols("widget", kind="class"))
on_graph("search_symbols_page", lambda g, b: g.search_symbols("widget", offset=5))
on_graph("search_symbols_visibility", lambda g, b: g.search_symbols("widget", visibility="private"))
on_graph("search_symbols_compact", lambda g, b: g.search_symbols("widget", compact=True))


def _indexed(g: CodeGraph, column: str) -> CodeGraph:
    """The graph with a posting index of one column, written as an index run writes it."""
    path = scratch_dir(g.spark)
    grams.postings(g.g.symbols, "id", column).write.partitionBy("bucket").parquet(path)
    setattr(g.g, f"{column}_grams", g.spark.read.schema(GRAMS).parquet(path))
    return g


on_graph("search_symbols_indexed", lambda g, b: _indexed(g, "name").search_symbols("WIDGET_", limit=1 << 30))
on_graph("search_symbols_indexed_short", lambda g, b: _indexed(g, "name").search_symbols("t_", limit=1 << 30))
on_graph("search_docs_indexed", lambda g, b: _indexed(g, "doc").search_docs("D Bolt", limit=1 << 30))
on_graph("get_symbol", lambda g, b: g.get_symbol("blue_bolt"))
on_graph("symbols_in_file", lambda g, b: g.symbols_in_file(_path3(b)))
on_graph("search_docs", lambda g, b: g.search_docs("bolt"))
on_graph("list_files", lambda g, b: g.list_files("economy"))
on_graph("module_overview", lambda g, b: g.module_overview().select("module", "files", F.explode("kinds").alias("kind", "n")))
on_graph("overview_files", lambda g, b: g.overview())
on_graph("stats", lambda g, b: g.stats())
on_graph("callers", lambda g, b: g.callers("blue_bolt"))
on_graph("callees", lambda g, b: g.callees("blue_bolt"))
on_graph("callers_compact", lambda g, b: g.callers("blue_bolt", compact=True))
on_graph("uses", lambda g, b: g.uses(_least_name(g, g.g.uses, "src")))
on_graph("used_by", lambda g, b: g.used_by(_least_name(g, g.g.uses, "dst")))
on_graph("imports", lambda g, b: g.imports(_path3(b)))
on_graph("dependents", lambda g, b: g.dependents(_path3(b)))
on_graph("hot_symbols_calls", lambda g, b: g.hot_symbols(10, "CALLS"))
on_graph("hot_symbols_uses", lambda g, b: g.hot_symbols(10, "USES"))
on_graph("hot_symbols_inherits", lambda g, b: g.hot_symbols(10, "INHERITS"))
for _edge in ("IMPORTS", "CALLS", "USES", "INHERITS"):
    on_graph(f"arch_violations_{_edge.lower()}", lambda g, b, e=_edge: g.architecture_violations("economy/", "small/", e))
on_graph("hot_symbols_invalid_edge", lambda g, b: g.hot_symbols(10, "IMPORTS"))
on_graph("arch_violations_invalid_edge", lambda g, b: g.architecture_violations("economy/", "small/", "CONTAINS"))
on_graph("callers_k", lambda g, b: g.callers("blue_bolt", depth=2))
on_graph("callees_k", lambda g, b: g.callees("blue_bolt", depth=2))
on_graph("inheritors_k", lambda g, b: g.inheritors("blue_bolt", depth=3))
on_graph("inherited_from_k", lambda g, b: g.inherited_from(_least_name(g, g.g.inherits, "src"), depth=3))
on_graph("shortest_path", lambda g, b: g.path(b.name_of(3), b.name_of(PATH_TARGET)))
on_graph("subgraph", lambda g, b: g.subgraph(["blue_bolt", b.name_of(3)]))


on_graph("cypher_callers", lambda g, b: cypher(g.g, "MATCH (a:Symbol)-[c:CALLS]->(b:Symbol {name:'blue_bolt'}) RETURN DISTINCT a.name AS name, c.confidence AS confidence, c.line AS line"))
on_graph("cypher_kinds", lambda g, b: cypher(g.g, "MATCH (s:Symbol) WHERE s.visibility <> 'private' AND NOT s.name ENDS WITH '0' RETURN s.kind AS kind, count(*) AS n ORDER BY n DESC, kind"))
on_graph("cypher_reach", lambda g, b: cypher(g.g, "MATCH (a:Symbol {name:'blue_bolt'})-[:INHERITS|USES*1..2]->(b:Symbol) RETURN DISTINCT b.id AS id"))
on_graph(
    "cypher_shortest",
    lambda g, b: cypher(g.g, "MATCH (a:Symbol {id:$a})-[e:CALLS* SHORTEST 1..3]->(b:Symbol) RETURN b.id AS id, list_transform(nodes(e), n -> n.id) AS mid", a=b.id_of(3)).select(
        "id", F.size("mid").alias("between")
    ),
)
on_graph("cypher_files", lambda g, b: cypher(g.g, "MATCH (s:Symbol)-[:DEFINED_IN]->(f:File) WHERE f.path STARTS WITH 'economy' RETURN f.path AS path, count(s) AS n"))


def _least_name(g: CodeGraph, edges: DataFrame, end: str) -> str:
    """The first name by alphabet that has an edge at this end."""
    return g.g.symbols.join(edges.select(F.col(end).alias("id")), "id", "left_semi").agg(F.min("name")).first()[0]


@query
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    place = "source || '/' || lang || '/d' || (doc_id % 97) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END"
    raw = """CASE doc_id % 5 WHEN 0 THEN './d' || (doc_id * 7 % 97) WHEN 1 THEN '../' || lang || '/d' || (doc_id * 3 % 97)
        WHEN 2 THEN source || '.d' || (doc_id * 5 % 97) WHEN 3 THEN source || '/' || lang || '/d' || (doc_id * 11 % 97) ELSE 'missing.mod' || doc_id END"""
    return resolve.resolve_imports(d.selectExpr(f"{place} AS src_path", f"{raw} AS raw"), d.selectExpr(f"{place} AS path").distinct())


@query
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Binding(spark, sf_dir).calls


@query
def resolve_inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Binding(spark, sf_dir).inherits


@query
def resolve_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Binding(spark, sf_dir).uses


@query
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.contains(Binding(spark, sf_dir).symbols)


def _inside(b: Binding) -> DataFrame:
    return b.symbols.select(F.col("id").alias("item"), "path", (F.col("start_byte") + 2).alias("byte"), F.lit(None).cast("string").alias("self"))


@query
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Binding(spark, sf_dir)
    return resolve.enclosing(_inside(b), b.symbols)


@query
def enclosing_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Binding(spark, sf_dir)
    return resolve.enclosing(_inside(b), b.symbols, types_only=True)


def _ranks(b: Binding) -> DataFrame:
    return rank.symbol_ranks(b.symbols, b.calls, b.uses, b.inherits).select("id", F.round("rank", 8).alias("rank"))


@query
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(Binding(spark, sf_dir))


@query
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Binding(spark, sf_dir)
    g = b.graph()
    g.symbols = b.symbols.drop("rank").join(_ranks(b), "id")
    return CodeGraph(g).repo_map().select("id", "rank")


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents").selectExpr("doc_id", "sha1(CAST(text AS BINARY)) AS h")
    old = d.where("doc_id % 10 <> 0").selectExpr("'doc/' || doc_id AS path", "CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE h END AS hash")
    gone = d.where("doc_id % 50 = 0").selectExpr("'doc/' || (-1 - doc_id) AS path", "h AS hash")
    return old.unionByName(gone), d.selectExpr("'doc/' || doc_id AS path", "h AS hash")


@query
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest_diff(*_manifests(spark, sf_dir))


@query
def extract_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweave.functions.text import cache_key

    old, new = _manifests(spark, sf_dir)
    return incremental.cache_misses(new, old.select(cache_key(F.col("path"), F.col("hash"), 1).alias("cache_key")), version=1)


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.upsert(*_manifests(spark, sf_dir), "path")


def _delete(g: CodeGraph, b: Binding) -> DataFrame:
    after = incremental.delete_file(g.g, _path3(b))
    parts = {"symbols": after.symbols, "calls": after.calls, "uses": after.uses, "inherits": after.inherits, "contains": after.contains, "imports": after.imports}
    out = None
    for label, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


on_graph("delete_file", _delete)


@query
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Binding(spark, sf_dir).keyed
    return incremental.with_known_ends(s.selectExpr("id AS src", "path || '#' || (pk + 150) AS dst"), s)


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("hash"))


_SUFFIX = "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.go' WHEN 4 THEN '.md' WHEN 5 THEN '.rs' WHEN 6 THEN '' ELSE '.php' END"
_DOC_PATH = f"source || '/' || lang || '/d' || doc_id || {_SUFFIX}"


#: A source file for each path of the bound graph: for each of its symbols, in order, a class with a method that calls another one's.
SOURCES = """
    SELECT path, concat_ws('', transform(array_sort(collect_list(struct(pk, text))), x -> x.text)) AS content FROM (
        SELECT path, pk, '# part ' || pk || char(10) || 'class C' || pk || '(B' || pk % 7 || '):' || char(10) || '    def m' || pk || '(self, x: T' || pk % 5 || '):' || char(10)
            || '        return self.m' || (pk * 7 + 3) % 1000 || '(x)' || char(10) || char(10) AS text FROM {keyed}) GROUP BY path
"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(SOURCES, keyed=Binding(spark, sf_dir).keyed)
    return extract_files(files.select("path", F.col("content").cast("binary").alias("content")))


@query
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(F.explode("symbols").alias("s")).select("s.path", "s.name", "s.kind", "s.line_start", "s.line_end", "s.start_byte", "s.end_byte", "s.signature", "s.doc")


@query
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("path", F.explode("callsites").alias("c")).select("path", "c.callee_name", "c.line")


@query
def extract_bases_and_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark, sf_dir)
    bases = rows.select("path", F.explode("inherits").alias("i")).select("path", F.lit("base").alias("what"), F.col("i.base").alias("name"))
    return bases.unionByName(rows.select("path", F.explode("uses").alias("u")).select("path", F.lit("use").alias("what"), F.col("u.type_name").alias("name")))


@query
def extract_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("path", F.size("contains").alias("n"), "lang")


def _of_language(lang: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # dealt out by path before the sources are made: extraction is long work on little data, which the adaptive planner would leave to few tasks
        keyed = Binding(spark, sf_dir).keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
        return extract_facts(spark.sql(shapes.sources(shapes.SHAPES[lang]), keyed=keyed))

    return run


for _lang in shapes.SHAPES:
    QUERIES[f"extract_{_lang}"] = _of_language(_lang)


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", language_of(F.expr(_DOC_PATH)).alias("lang"))


def _paths(d: DataFrame, root: str, other: str) -> DataFrame:
    where = f"CASE doc_id % 6 WHEN 0 THEN '{root}' WHEN 1 THEN '{root}node_modules/' WHEN 2 THEN '{root}.hidden/' WHEN 3 THEN '{root}src/' WHEN 4 THEN '{other}' ELSE '{root}a/b/' END"
    return d.select(F.expr(f"{where} || {_DOC_PATH}").alias("path"))


@query
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_table(spark, sf_dir, "documents"), "", "build/").where(is_source(F.col("path")))


@query
def read_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every page, from offsets in and behind its multi-byte characters."""
    p = _table(spark, sf_dir, "pages").selectExpr("page_id", "html", "octet_length(substring(html, 1, CAST(page_id % 400 AS INT))) AS a", "octet_length(substring(html, 1, CAST(page_id % 400 + 900 AS INT))) AS b")
    return p.select("page_id", body_of(F.col("html").cast("binary"), F.col("a"), F.col("b")).alias("body"))


def _batch(g: CodeGraph, b: Binding) -> DataFrame:
    ends = b.symbols.groupBy("path").agg(F.max("end_byte").cast("int").alias("n"))
    g.sources = ends.select("path", F.rpad("path", F.col("n"), F.concat("path", F.lit(";"))).cast("binary").alias("content"))
    return g.batch_read_symbol_bodies(["blue_bolt", "no such symbol", b.id_of(7)])


on_graph("batch_bodies", _batch)


@query
def project_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", slug_of(F.col("url")).alias("slug"))


@query
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against all pages: a third of the roots have moved."""
    p = _table(spark, sf_dir, "pages")
    new = p.select(F.expr("CASE WHEN page_id % 3 = 0 THEN url || '/moved' ELSE url END").alias("root"), F.lit(2).alias("version"))
    return incremental.upsert(p.select(F.col("url").alias("root"), F.lit(1).alias("version")), new, "root")


@query
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = vectors.where("id = '0'").first()["embedding"]
    return similarity.nearest(vectors, list(asked), 15).select("id", F.round("score", 6).alias("score"))


@query
def latent_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix that vectors are learned from: how much more often than by chance each word is in each document."""
    seen = materialize(latent.counted(_table(spark, sf_dir, "documents"), "doc_id", "text"))  # read three times
    return latent.matrix(seen, "doc_id", least=2)[0].select("doc_id", "token", F.round("x", 6).alias("x"))


@query
def watch_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_table(spark, sf_dir, "documents"), "/w/", "/other/").where(watch.relevant(F.col("path"), "/w"))


def _debounce(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("ts", (F.col("event_type") == "purchase").alias("head"))
    return watch.debounce(events, gap)


@query
def watch_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _debounce(spark, sf_dir, "10 minutes")


@query
def watch_debounce_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _debounce(spark, sf_dir, "1.5 seconds")

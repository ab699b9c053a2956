"""The query surface: 23 tools over a graph, each a method that returns a DataFrame.

A ``ref`` is a symbol id or, failing that, a name (the first by path). Where an order leaves ties, the id
decides, so results are the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.functions.text import body_of, compact, location, module_of
from codeweave.operators import grams, similarity, traverse
from codeweave.schema import MAPPED_KINDS, SYMBOL_EDGES, Graph


def at() -> Column:
    return location(F.col("path"), F.col("line_start"))


def span() -> Column:
    return location(F.col("path"), F.col("line_start"), F.col("line_end"))


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(limit)


def _row(*names: str) -> Column:
    return compact(*[F.col(n) for n in names]).alias("row")


class CodeGraph:
    def __init__(self, graph: Graph, sources: DataFrame | None = None, encoder=None):
        """``sources``: (path, content binary) for reading bodies; ``encoder``: text -> list of floats."""
        self.g, self.sources, self.encoder = graph, sources, encoder
        self.spark = graph.symbols.sparkSession

    # look-ups
    def _containing(self, symbols: DataFrame, index: DataFrame | None, column: str, query: str) -> DataFrame:
        """Symbols whose text contains ``query`` in any case: through the posting index if the graph has one, else by a scan."""
        if index is None:
            return symbols.where(F.contains(F.lower(column), F.lower(F.lit(query))))
        return grams.containing(symbols, index, query, "id", column)

    def search_symbols(self, query: str, kind: str | None = None, limit: int = 20, offset: int = 0, compact: bool = False, visibility: str | None = None) -> DataFrame:
        hits = self._containing(self.g.symbols, self.g.name_grams, "name", query)
        hits = hits.where(F.col("kind") == kind) if kind else hits
        hits = hits.where(F.col("visibility") == visibility) if visibility else hits
        out = _page(hits.orderBy("name", "id"), limit, offset).select("id", "name", "kind", at().alias("location"), "signature", "visibility", "modifiers")
        return out.select(_row("name", "kind", "location", "signature")) if compact else out

    def _by_ref(self, refs: DataFrame) -> DataFrame:
        """(ord, ref) with the symbol of each ref; two equi-joins, then the best candidate."""
        s = self.g.symbols
        exact = refs.join(s, refs["ref"] == s["id"]).withColumn("by_name", F.lit(0))
        named = refs.join(s, refs["ref"] == s["name"]).withColumn("by_name", F.lit(1))
        best = F.row_number().over(Window.partitionBy("ord").orderBy("by_name", "path", "id"))
        return exact.unionByName(named).withColumn("best", best).where("best = 1").drop("best", "by_name")

    def _refs(self, refs: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(refs)), "ord int, ref string")

    def get_symbol(self, ref: str) -> DataFrame:
        hits = self.g.symbols.where((F.col("id") == ref) | (F.col("name") == ref)).orderBy(F.col("id") != ref, "path", "id").limit(1)
        return hits.select("id", "name", "kind", span().alias("location"), "signature", "doc")

    def symbols_in_file(self, path: str, compact: bool = False, visibility: str | None = None) -> DataFrame:
        hits = self.g.symbols.where(F.col("path") == path)
        hits = hits.where(F.col("visibility") == visibility) if visibility else hits
        out = hits.orderBy("line_start", "id").select("id", "name", "kind", span().alias("location"), "signature", "doc", "visibility", "modifiers")
        return out.select(_row("name", "kind", "location", "signature")) if compact else out

    def search_docs(self, query: str, limit: int = 20, offset: int = 0, compact: bool = False) -> DataFrame:
        hits = self._containing(self.g.symbols.where(F.col("doc") != ""), self.g.doc_grams, "doc", query)
        out = _page(hits.orderBy("name", "id"), limit, offset).select("id", "name", "kind", at().alias("location"), "doc")
        return out.select(_row("name", "kind", "location")) if compact else out

    def _under(self, df: DataFrame, prefix: str | None) -> DataFrame:
        return df.where(F.startswith("path", F.lit(prefix))) if prefix else df

    def list_files(self, dir_prefix: str | None = None) -> DataFrame:
        return self._under(self.g.files, dir_prefix).select("path").orderBy("path")

    # one hop and k hops
    def _neighbours(self, name: str, kind: str, incoming: bool) -> DataFrame:
        """The symbols at the other end of a named symbol's edges, with the edge's columns."""
        near, far = ("dst", "src") if incoming else ("src", "dst")
        start = self.g.symbols.where(F.col("name") == name).select(F.col("id").alias(near))
        return self.g.edges(kind).join(start, near).join(self.g.symbols.withColumnRenamed("id", far), far)

    def _reach(self, name: str, kind: str, incoming: bool, depth: int) -> DataFrame:
        edges = self.g.edges(kind).select("src", "dst")
        if incoming:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = self.g.symbols.where(F.col("name") == name)
        return self.g.symbols.join(traverse.k_hop(edges, start, depth), "id")

    def _calls(self, name: str, depth: int, short: bool, incoming: bool) -> DataFrame:
        if traverse.clamp(depth) == 1:
            out = self._neighbours(name, "CALLS", incoming).select("name", at().alias("location"), "confidence", F.col("line").alias("call_line")).distinct()
            if short:
                return out.select(compact(F.col("name"), F.col("location"), F.col("confidence"), F.concat(F.lit("@"), F.col("call_line").cast("string"))).alias("row"))
            return out
        out = self._reach(name, "CALLS", incoming, depth).select("name", at().alias("location")).distinct()
        return out.select(_row("name", "location")) if short else out

    def callers(self, name: str, depth: int = 1, compact: bool = False) -> DataFrame:
        return self._calls(name, depth, compact, True)

    def callees(self, name: str, depth: int = 1, compact: bool = False) -> DataFrame:
        return self._calls(name, depth, compact, False)

    def _used(self, name: str, short: bool, incoming: bool) -> DataFrame:
        out = self._neighbours(name, "USES", incoming).select("name", "kind", at().alias("location"), "confidence").distinct().orderBy("name", "location")
        return out.select(_row("name", "kind", "location", "confidence")) if short else out

    def uses(self, name: str, compact: bool = False) -> DataFrame:
        return self._used(name, compact, False)

    def used_by(self, name: str, compact: bool = False) -> DataFrame:
        return self._used(name, compact, True)

    def _line(self, name: str, depth: int, short: bool, incoming: bool) -> DataFrame:
        out = self._reach(name, "INHERITS", incoming, depth).select("name", "kind", at().alias("location")).distinct()
        return out.select(_row("name", "kind", "location")) if short else out

    def inheritors(self, name: str, depth: int = 1, compact: bool = False) -> DataFrame:
        return self._line(name, depth, compact, True)

    def inherited_from(self, name: str, depth: int = 1, compact: bool = False) -> DataFrame:
        return self._line(name, depth, compact, False)

    def imports(self, path: str) -> DataFrame:
        return self.g.imports.where(F.col("src_path") == path).select(F.col("dst_path").alias("path"))

    def dependents(self, path: str) -> DataFrame:
        return self.g.imports.where(F.col("dst_path") == path).select(F.col("src_path").alias("path"))

    def path(self, src_name: str, dst_name: str) -> DataFrame:
        """(ord, name) along a shortest chain of calls; no rows if there is none within six."""
        s = self.g.symbols
        found = traverse.shortest_path(self.g.calls, s.where(F.col("name") == src_name), s.where(F.col("name") == dst_name))
        steps = found.select(F.posexplode("ids").alias("ord", "id"))
        return steps.join(s.select("id", "name"), "id").select("ord", "name").orderBy("ord")

    # overviews
    def repo_map(self, dir_prefix: str | None = None, budget_tokens: int = 2000) -> DataFrame:
        """The highest-ranked symbols, one display row each, as long as their quarter-length fits the budget."""
        top = self._under(self.g.symbols, dir_prefix).where(F.col("kind").isin(*MAPPED_KINDS)).orderBy(F.desc("rank"), "id").limit(500)
        row = F.concat_ws("\t", F.format_string("%.4f", "rank"), "kind", at(), F.substring("signature", 1, 160))
        costed = top.select("id", "rank", row.alias("row")).withColumn("cost", F.expr("length(row) div 4"))
        running = F.sum("cost").over(Window.orderBy(F.desc("rank"), "id").rowsBetween(Window.unboundedPreceding, 0))  # over 500 rows at most
        return costed.withColumn("spent", running).where(F.col("spent") <= budget_tokens).select("id", "rank", "row").orderBy(F.desc("rank"), "id")

    def search_semantic(self, query: str | list[float], limit: int = 15, compact: bool = False) -> DataFrame:
        columns = "id string, name string, kind string, location string, signature string, doc string, score double"
        if self.g.embeddings is None:
            out = self.spark.createDataFrame([], columns)
        else:
            vector = self.encoder(query) if isinstance(query, str) else query
            top = similarity.nearest(self.g.embeddings, vector, limit)
            out = top.join(self.g.symbols, "id").select("id", "name", "kind", span().alias("location"), "signature", "doc", F.round("score", 4).alias("score"))
            out = out.orderBy(F.desc("score"), "id")
        return out.select(_row("name", "kind", "location", "score")) if compact else out

    def module_overview(self, dir_prefix: str | None = None) -> DataFrame:
        """(module, files, kinds map): files and symbols by kind of every top directory."""
        s = self._under(self.g.symbols, dir_prefix).withColumn("module", module_of(F.col("path")))
        kinds = s.groupBy("module", "kind").agg(F.count("*").alias("n")).groupBy("module").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
        files = s.groupBy("module").agg(F.count_distinct("path").alias("files"))
        return files.join(kinds, "module").orderBy("module")

    def hot_symbols(self, n: int = 10, edge: str = "CALLS") -> DataFrame:
        schema = "name string, kind string, location string, in_degree bigint"
        if edge not in SYMBOL_EDGES:
            return self.spark.createDataFrame([], schema)
        # degrees first: the join then moves a row a symbol, not a row an edge
        degree = self.g.edges(edge).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        shown = degree.join(self.g.symbols, "id").groupBy("name", "kind", "path", "line_start").agg(F.sum("n").alias("in_degree"))
        return shown.orderBy(F.desc("in_degree"), "path", "line_start", "name").limit(n).select("name", "kind", at().alias("location"), "in_degree")

    def architecture_violations(self, from_prefix: str, not_to_prefix: str, edge: str = "IMPORTS") -> DataFrame:
        a, b = F.lit(from_prefix), F.lit(not_to_prefix)
        if edge == "IMPORTS":
            i = self.g.imports.where(F.startswith("src_path", a) & F.startswith("dst_path", b))
            return i.select(F.col("src_path").alias("from"), F.col("dst_path").alias("to")).orderBy("from", "to")
        if edge not in SYMBOL_EDGES:
            return self.spark.createDataFrame([], "from string, to string")
        shown = F.concat("name", F.lit(" ("), "path", F.lit(")"))
        left = self.g.symbols.where(F.startswith("path", a)).select(F.col("id").alias("src"), shown.alias("from"))
        right = self.g.symbols.where(F.startswith("path", b)).select(F.col("id").alias("dst"), shown.alias("to"))
        return self.g.edges(edge).join(left, "src").join(right, "dst").select("from", "to").distinct().orderBy("from", "to")

    def subgraph(self, names: list[str], depth: int = 1) -> DataFrame:
        """(section, name, kind, location): the focal symbols, and their callers, callees, uses and users by name.

        One symbol a name: the last by (name, path, line). Focal names are left out of the other sections.
        """
        depth = traverse.clamp(depth, 2)
        wanted = F.coalesce(F.col("name").isin(list(dict.fromkeys(names))), F.lit(False))  # as long as the caller's list
        focal = self.g.symbols.where(wanted)
        start = focal.select("id")

        def section(title: str, kind: str, incoming: bool, hops: int) -> DataFrame:
            e = self.g.edges(kind).select("src", "dst")
            if incoming:
                e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            return self.g.symbols.join(traverse.k_hop(e, start, hops), "id").where(~wanted).withColumn("section", F.lit(title))

        parts = [
            focal.withColumn("section", F.lit("focal")),
            section("callers", "CALLS", True, depth),
            section("callees", "CALLS", False, depth),
            section("uses", "USES", False, 1),
            section("used_by", "USES", True, 1),
        ]
        rows = reduce(DataFrame.unionByName, [p.select("section", "name", "kind", "path", "line_start", "id") for p in parts])
        last = rows.groupBy("section", "name").agg(F.max_by(F.struct("kind", at().alias("location")), F.struct("path", "line_start", "id")).alias("s"))
        return last.select("section", "name", "s.kind", "s.location")

    def _bodies(self, found: DataFrame) -> DataFrame:
        content = self.sources.select("path", "content")
        body = F.coalesce(body_of(F.col("content"), F.col("start_byte"), F.col("end_byte")), F.lit(""))
        return found.join(content, "path", "left").withColumn("body", body)

    def read_symbol_body(self, ref: str) -> DataFrame:
        return self._bodies(self._by_ref(self._refs([ref]))).select(span().alias("location"), "kind", "body")

    def batch_read_symbol_bodies(self, refs: list[str]) -> DataFrame:
        """(ord, ref, location, kind, body, error) in the order asked for."""
        asked = self._refs(refs)
        found = self._bodies(self._by_ref(asked)).select("ord", span().alias("location"), "kind", "body")
        out = asked.join(found, "ord", "left")
        return out.withColumn("error", F.when(F.col("kind").isNull(), F.lit("not found"))).orderBy("ord")

    def overview(self) -> DataFrame:
        """(path, symbols) of every file that has any, most first."""
        return self.g.symbols.groupBy("path").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "path")

    def stats(self) -> DataFrame:
        """(label, n) for the node and edge tables, in one plan."""
        g = self.g
        counted = {"File": g.files, "Symbol": g.symbols, "DEFINED_IN": g.symbols, "CONTAINS": g.contains, "INHERITS": g.inherits, "IMPORTS": g.imports, "CALLS": g.calls, "USES": g.uses}
        return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in counted.items()])

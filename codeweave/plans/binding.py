"""A deterministic code graph over the star-schema tables, so that every graph operator runs at any scale.

Parts are symbols (a file per type and brand), lines of an order call each other in turn, and imports,
bases and type uses follow from part keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.operators.resolve import contains, resolve_calls, resolve_inherits, resolve_uses
from codeweave.plans.scratch import shuffled
from codeweave.schema import Graph

# The same text runs in the oracles.
SYM = """
    SELECT path || '#' || p_partkey AS id,
        replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_partkey ELSE '' END AS name,
        CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' ELSE 'type' END AS kind,
        path, 'python' AS lang, CAST(p_size AS BIGINT) AS line_start, CAST(p_size + p_partkey % 7 AS BIGINT) AS line_end,
        CAST(p_partkey AS BIGINT) AS start_byte, CAST(p_partkey + 1 + p_partkey % 50 AS BIGINT) AS end_byte, p_name AS signature,
        CASE WHEN p_partkey % 4 = 0 THEN '# ' || p_name ELSE '' END AS doc,
        CASE WHEN p_partkey % 6 = 0 THEN 'private' ELSE 'public' END AS visibility, '' AS modifiers, p_partkey AS pk
    FROM (SELECT *, lower(p_type) || '/' || replace(p_brand, '#', '_') || '.py' AS path FROM {part}) AS p
"""
IMP = """
    SELECT DISTINCT a.path AS src_path, b.path AS dst_path FROM {sym} AS a JOIN {sym} AS b
    ON b.pk = (a.pk * 7 + 3) % (SELECT count(*) FROM {sym}) WHERE a.path <> b.path
"""
CS = """
    SELECT a.id AS src, b.name AS name, CAST(min(x.n) AS BIGINT) AS line
    FROM (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM {lineitem} GROUP BY 1, 2) AS x
    JOIN (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM {lineitem} GROUP BY 1, 2) AS y ON x.o = y.o AND y.n = x.n + 1
    JOIN {sym} AS a ON a.pk = x.p JOIN {sym} AS b ON b.pk = y.p GROUP BY 1, 2
"""
INH_RAW = "SELECT a.id AS src, b.name AS name FROM {sym} AS a JOIN {sym} AS b ON b.pk * 2 = a.pk - a.pk % 2 WHERE a.kind IN ('class', 'interface')"
USE_RAW = "SELECT a.id AS src, b.name AS name FROM {sym} AS a JOIN {sym} AS b ON b.pk = (a.pk * 3) % (SELECT count(*) FROM {sym}) WHERE a.kind = 'class'"


class Binding:
    """The raw references of the bound graph, and the graph resolved from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        read = lambda t: shuffled(spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        self.spark = spark
        self.keyed = spark.sql(SYM, part=read("part"))
        self.symbols = self.keyed.selectExpr("*", "CAST(0 AS DOUBLE) AS rank").drop("pk")
        self.order = "id"
        self.imports = spark.sql(IMP, sym=self.keyed)
        self.lines = read("lineitem")
        self.callsites = spark.sql(CS, sym=self.keyed, lineitem=self.lines)
        self.bases = spark.sql(INH_RAW, sym=self.keyed)
        self.type_refs = spark.sql(USE_RAW, sym=self.keyed)

    def name_of(self, key: int) -> str:
        return self.keyed.where(f"pk = {key}").first()["name"]

    def id_of(self, key: int) -> str:
        return self.keyed.where(f"pk = {key}").first()["id"]

    @property
    def by_id(self) -> DataFrame:
        """Symbols as the resolvers see them: ordered by id."""
        return self.symbols.select("id", "name", "path", "kind")

    @property
    def called(self) -> DataFrame:
        """(src_path, name, calls): how many symbols of a file call a name. Callsites added up, from one shuffle of the lines, and in keys as long as keys do."""
        lines = self.lines.where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p")
        lines = lines.repartition("o").groupBy("o", "n").agg(F.min("p").alias("p"))
        after = F.lead(F.struct("n", "p")).over(Window.partitionBy("o").orderBy("n"))
        pairs = lines.withColumn("after", after).where("after.n = n + 1").select("p", F.col("after.p").alias("q"))
        named = pairs.join(shuffled(self.keyed).selectExpr("pk AS q", "name"), "q").select("p", "name")
        once = named.join(shuffled(self.keyed).selectExpr("pk AS p", "path AS src_path"), "p").distinct()
        return once.groupBy("src_path", "name").agg(F.count("*").alias("calls"))

    @property
    def calls(self) -> DataFrame:
        return resolve_calls(self.callsites, self.by_id, self.imports)

    @property
    def inherits(self) -> DataFrame:
        return resolve_inherits(self.bases, self.by_id)

    @property
    def uses(self) -> DataFrame:
        return resolve_uses(self.type_refs, self.by_id)

    def graph(self) -> Graph:
        files = self.symbols.selectExpr("path", "lang", "sha1(CAST(path AS BINARY)) AS hash").distinct()
        return Graph(files, self.symbols, self.calls, self.uses, self.inherits, contains(self.symbols), self.imports)

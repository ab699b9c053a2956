"""Job 2: the architecture report, a snapshot of how the modules of a code base hang together.

    python -m jobs.module_report --tables TABLES --out OUT [--config jobs/module_report.json]

TABLES is a folder with the tables that the graph is bound to (``part.parquet``, ``lineitem.parquet``). The job resolves their
calls, uses and bases as an index run does, and writes, partitioned by snapshot and module:

* ``edges``: for each module, other module (also itself) and kind of edge, how many edges go there and how sure they are,
* ``hot``: the symbols of each module that most edges from *other* modules end at, ``top`` for each,
* ``cycle``: modules that depend on each other, with the edges of the weaker direction, those that would have to go.

A snapshot is the folder OUT/as_of=NAME. It is written whole in one overwrite, so running a job again gives the
same snapshot, also where modules are gone since, and other snapshots stay for comparison.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.functions.text import module_of
from codeweave.operators.resolve import resolve_counted
from codeweave.plans.binding import Binding
from codeweave.plans.scratch import discard, materialize, release
from jobs.common import command, log, stored

DEFAULTS = {"as_of": "latest", "top": 10}
REPORT = "part string, item string, kind string, n long, unsure long, rank int, as_of string, module string"
#: Kinds of edges that are resolved one by one.
KINDS = {"USES": "uses", "INHERITS": "inherits"}


def links(bound: Binding, called: DataFrame) -> DataFrame:
    """(module, other, dst, kind, n, unsure): edges from each module to each symbol, added up before anything else is joined; ``called`` is the binding's, written."""
    module = bound.symbols.select("id", module_of(F.col("path")).alias("module"))
    ambiguous = F.col("confidence") == "AMBIGUOUS"
    edges = reduce(DataFrame.unionByName, [getattr(bound, table).select("src", "dst", F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"), ambiguous.cast("long").alias("unsure")) for kind, table in KINDS.items()])
    edges = edges.join(module.select(F.col("id").alias("src"), "module"), "src").select("module", "dst", "kind", "n", "unsure")
    # calls are most of the edges: they are resolved once for all callers of a name in a file
    calls = resolve_counted(called, bound.by_id, bound.imports)
    calls = calls.select(module_of(F.col("src_path")).alias("module"), "dst", F.lit("CALLS").alias("kind"), F.col("calls").alias("n"), F.when(ambiguous, F.col("calls")).otherwise(0).alias("unsure"))
    sent = edges.unionByName(calls).groupBy("module", "dst", "kind").agg(F.sum("n").alias("n"), F.sum("unsure").alias("unsure"))
    return sent.join(module.select(F.col("id").alias("dst"), F.col("module").alias("other")), "dst")


def report(sent: DataFrame, top: int) -> DataFrame:
    """The rows of a snapshot from its :func:`links`, which are read several times."""
    matrix = sent.groupBy("module", "other", "kind").agg(F.sum("n").alias("n"), F.sum("unsure").alias("unsure"))
    rank = F.lit(None).cast("int").alias("rank")
    edges = matrix.select("module", F.lit("edges").alias("part"), F.col("other").alias("item"), "kind", "n", "unsure", rank)

    foreign = sent.where("module <> other").groupBy(F.col("other").alias("module"), F.col("dst").alias("item")).agg(F.sum("n").alias("n"), F.sum("unsure").alias("unsure"))
    order = Window.partitionBy("module").orderBy(F.desc("n"), "item")
    hot = foreign.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("module", F.lit("hot").alias("part"), "item", F.lit(None).cast("string").alias("kind"), "n", "unsure", "rank")

    depends = matrix.where("module <> other").groupBy("module", "other").agg(F.sum("n").alias("n"), F.sum("unsure").alias("unsure"))
    back = depends.select(F.col("module").alias("other"), F.col("other").alias("module"), F.col("n").alias("back"))
    # the weaker direction of each pair; of equal ones that from the later name
    weaker = depends.join(back, ["module", "other"]).where((F.col("n") < F.col("back")) | ((F.col("n") == F.col("back")) & (F.col("module") > F.col("other"))))
    cycles = weaker.select("module", F.lit("cycle").alias("part"), F.col("other").alias("item"), F.lit(None).cast("string").alias("kind"), "n", "unsure", rank)
    return edges.unionByName(hot).unionByName(cycles)


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Writes the snapshot of ``tables``; how many rows of each part it has."""
    settings = {**DEFAULTS, **(config or {})}
    log.info("reading part and lineitem in %s", tables)
    to = f"{out}/as_of={settings['as_of']}"
    # resolved once: below OUT, as executors share it, in a folder that no reader of OUT looks at
    once = lambda df: materialize(df, f"{out}/_work/codeweave/{uuid4().hex}")
    bound = Binding(spark, tables)
    called = once(bound.called)
    release(spark)  # shuffle files of a step go before the next one, and before the next run
    sent = once(links(bound, called))
    discard(spark, called)
    release(spark)
    rows = report(sent, settings["top"])
    rows.repartition("module").sortWithinPartitions("part", "rank", "item").write.mode("overwrite").partitionBy("module").parquet(to)
    discard(spark, sent)
    release(spark)
    parts = {r["part"]: r["count"] for r in stored(spark, to, REPORT).groupBy("part").count().collect()}
    wrote = {"rows": sum(parts.values()), **{p: parts.get(p, 0) for p in ("edges", "hot", "cycle")}}
    log.info("wrote to %s: %s", to, wrote)
    return wrote


def read(spark: SparkSession, out: str) -> DataFrame:
    """All snapshots."""
    return stored(spark, out, REPORT)


if __name__ == "__main__":
    command(__doc__, "jobs/module_report.json", DEFAULTS, lambda spark, a, config: run(spark, a.tables, a.out, config), "tables", "out")

"""Name resolution: raw references to typed edges with a confidence.

Candidates of a name are counted once per name and once per (name, file); a reference is then settled by
the first rule that applies: the only symbol of that name, the only one in the same file, the only one
in imported files (calls), or else the first five. Only the last rule fans out, by five at most, so a
name with very many candidates costs no more than one with six. Symbols are ordered by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave.functions.text import normalised_path, stem_of, without_extension
from codeweave.plans.scratch import shuffled
from codeweave.schema import AMBIGUOUS, ENCLOSING_TYPES, EXTRACTED, INFERRED, RESOLVED_TYPES

FAN_OUT = 5


def symbol_order(symbols: DataFrame) -> Column:
    return F.struct("path", "start_byte", "id") if "start_byte" in symbols.columns else F.struct("id")


def _targets(refs: DataFrame, candidates: DataFrame, order: Column, imports: DataFrame | None, *keep: str) -> DataFrame:
    """(``keep``, dst, confidence) of refs (src_path, name, ``keep``): what they mean follows from the file and the name alone."""
    cand = shuffled(candidates).select("id", "name", "path", order.alias("ord"))
    by_name = cand.groupBy("name").agg(F.count("*").alias("n"), F.min_by("id", "ord").alias("only"))
    by_file = cand.groupBy("name", "path").agg(F.count("*").alias("k"), F.min_by("id", "ord").alias("here"))
    first = cand.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).where(F.col("place") <= FAN_OUT)

    known = refs.join(by_name, "name")
    local = by_file.where("k = 1").select("name", F.col("path").alias("src_path"), "here")
    known = known.join(local, ["name", "src_path"], "left")
    settled = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("here"))
    if imports is not None:
        wanted = known.where("n > 1 AND here IS NULL").select("name", "src_path").distinct()
        reachable = wanted.join(shuffled(imports).select("src_path", F.col("dst_path").alias("path")), "src_path").join(by_file, ["name", "path"])
        imported = reachable.groupBy("name", "src_path").agg(F.sum("k").alias("hits"), F.min("here").alias("there")).where("hits = 1")
        known = known.join(shuffled(imported).select("name", "src_path", "there"), ["name", "src_path"], "left")
    else:
        known = known.withColumn("there", F.lit(None).cast("string"))
    known = known.withColumn("dst", F.coalesce(settled, F.col("there"))).withColumn(
        "confidence", F.when(settled.isNotNull(), EXTRACTED).when(F.col("there").isNotNull(), INFERRED).otherwise(AMBIGUOUS)
    )
    one = known.where("dst IS NOT NULL").select(*keep, "dst", "confidence")
    many = known.where("dst IS NULL").drop("dst").join(first.select("name", F.col("id").alias("dst")).distinct(), "name").select(*keep, "dst", "confidence")
    return one.unionByName(many)


def _resolve(refs: DataFrame, candidates: DataFrame, order: Column, imports: DataFrame | None) -> DataFrame:
    """(src, dst, confidence, line) of refs (src, src_path, name, line), at most one row a (src, dst)."""
    return _targets(refs, candidates, order, imports, "src", "line").groupBy("src", "dst").agg(F.min_by("confidence", "line").alias("confidence"), F.min("line").alias("line"))


def _with_path(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return refs.join(shuffled(symbols).select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src")


def resolve_calls(callsites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """callsites (src, name, line) -> (src, dst, confidence, line); the first call of a pair counts, self calls stay."""
    first = callsites.groupBy("src", "name").agg(F.min("line").cast("long").alias("line"))
    return _resolve(_with_path(first, symbols), symbols, symbol_order(symbols), imports)


def resolve_counted(called: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """called (src_path, name, calls), a row a file and name -> (src_path, dst, calls, confidence): how many edges of :func:`resolve_calls` come from a file's symbols.

    An id has one name, so each caller of a name has one edge to each symbol that the name may mean. Names of one symbol are settled by one join.
    """
    names = shuffled(symbols).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("dst"))
    sure = called.join(names.where("n = 1"), "name").select("src_path", "dst", "calls", F.lit(EXTRACTED).alias("confidence"))
    others = called.join(names.where("n > 1").select("name"), "name", "left_semi")
    return sure.unionByName(_targets(others, symbols, symbol_order(symbols), imports, "src_path", "calls").select("src_path", "dst", "calls", "confidence"))


def resolve_inherits(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (src, name) -> (src, dst, confidence), among types only."""
    types = symbols.where(F.col("kind").isin(*RESOLVED_TYPES))
    rows = _with_path(refs.select("src", "name").distinct(), symbols).withColumn("line", F.lit(0).cast("long"))
    return _resolve(rows, types, symbol_order(types), None).drop("line")


def resolve_uses(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """As inheritance, without edges from a type to itself."""
    return resolve_inherits(refs, symbols).where("src <> dst")


def resolve_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw (src_path, raw) -> (src_path, dst_path).

    Relative imports: the file at the normalised path without extension, else the only file of that stem.
    Absolute ones: the only file whose stem is the last component, else the file at that path.
    """
    paths = files.select("path")
    by_place = paths.groupBy(without_extension(F.col("path")).alias("place")).agg(F.min("path").alias("at_place"))
    by_stem = paths.groupBy(stem_of(F.col("path")).alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("of_stem")).where("n = 1")
    refs = raw.select("src_path", "raw").distinct()
    relative = F.col("raw").startswith(".")
    parent = F.when(F.instr("src_path", "/") > 0, F.regexp_replace("src_path", r"/[^/]*$", "")).otherwise("")
    last = F.element_at(F.split("raw", r"[./\\]"), -1)
    refs = refs.withColumns(
        {
            "place": F.when(relative, normalised_path(F.concat_ws("/", parent, "raw"))).otherwise(F.col("raw")),
            "stem": F.when(relative, F.substring_index("raw", "/", -1)).otherwise(last),
            "relative": relative,
        }
    )
    found = refs.join(by_place, "place", "left").join(by_stem.select("stem", "of_stem"), "stem", "left")
    target = F.when(F.col("relative"), F.coalesce("at_place", "of_stem")).otherwise(F.coalesce("of_stem", "at_place"))
    return found.select("src_path", target.alias("dst_path")).where("dst_path IS NOT NULL AND dst_path <> src_path").distinct()


BIN = 4096


def enclosing(items: DataFrame, symbols: DataFrame, types_only: bool = False) -> DataFrame:
    """items (item, path, byte, self) -> (item, holder): the innermost symbol around the byte, other than ``self``.

    An interval join on (path, 4 KiB bin): symbols are entered in every bin that they touch, so a long file
    doesn't compare all of its symbols with all items. Ties: the smaller span, then the first symbol.
    """
    around = symbols.where(F.col("kind").isin(*ENCLOSING_TYPES)) if types_only else symbols
    spans = around.where("end_byte > start_byte").select(
        F.col("id").alias("holder"), "path", "start_byte", "end_byte", F.explode(F.expr(f"sequence(start_byte div {BIN}, (end_byte - 1) div {BIN})")).alias("bin")
    )
    at = items.withColumn("bin", F.expr(f"byte div {BIN}"))
    inside = at.join(spans, ["path", "bin"]).where("start_byte <= byte AND byte < end_byte AND NOT (holder <=> self)")
    rank = F.struct(F.col("end_byte") - F.col("start_byte"), F.col("holder"))
    return inside.groupBy("item").agg(F.min_by("holder", rank).alias("holder"))


def contains(symbols: DataFrame) -> DataFrame:
    """(src, dst): each symbol under the innermost symbol around its first byte."""
    items = symbols.select(F.col("id").alias("item"), "path", F.col("start_byte").alias("byte"), F.col("id").alias("self"))
    return enclosing(items, symbols).select(F.col("holder").alias("src"), F.col("item").alias("dst"))

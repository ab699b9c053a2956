"""A compiler for the graph patterns that code queries use, to DataFrames.

Grammar: ``MATCH`` of one node or of two nodes and a relationship; labels File and Symbol; property maps;
relationship types, one or several by ``|``, directed or not, ``*a..b`` (to 6), ``* SHORTEST a..b``; ``WHERE`` with AND, OR, NOT,
parentheses, ``= <> < <= > >=``, IN, CONTAINS, STARTS WITH, ENDS WITH, IS [NOT] NULL; ``RETURN [DISTINCT]``
of properties, ``n.*``, ``count(x)``, ``count(*)`` (grouped by the others), ``lower()``; of a relationship ``e`` of several
steps ``list_transform(nodes(e), n -> n.property)`` over the nodes between its ends, and of ``p = (a)-[...]-(b)`` the
path ``p``, an array of its nodes from end to end; ``ORDER BY``,
``SKIP``, ``LIMIT``; ``$parameters``. Anything else is an error, never a guess. For more, use
``spark.sql`` on the catalog's views.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.operators import traverse
from codeweave.plans.scratch import materialize
from codeweave.schema import Graph

_TOKEN = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+(?!\.))?)|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*)"
    r"|(?P<op><>|<=|>=|\.\.|->|<-|[-=<>()\[\]{}:,.*|]))"
)
_KEYWORDS = {"MATCH", "WHERE", "RETURN", "DISTINCT", "AS", "ORDER", "BY", "SKIP", "LIMIT", "AND", "OR", "NOT", "IN", "CONTAINS", "STARTS", "ENDS", "WITH", "IS", "NULL", "ASC", "DESC"}


class CypherError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip().rstrip(";").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"cannot read {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "word" and value.upper() in _KEYWORDS:
            kind, value = "key", value.upper()
        out.append((kind, value))
        at = m.end()
    return [*out, ("end", "")]


class Compiler:
    def __init__(self, graph: Graph, text: str, params: dict):
        self.g, self.params, self.t, self.i = graph, params, _tokens(text), 0
        self.labels: dict[str, str] = {}  # variable -> File, Symbol or REL
        self.anonymous = 0

    # reading
    def peek(self, value: str, ahead: int = 0) -> bool:
        kind, v = self.t[min(self.i + ahead, len(self.t) - 1)]
        return v == value and kind in ("op", "key")

    def accept(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise CypherError(f"expected {value}, found {self.t[self.i][1] or 'the end'}")

    def word(self) -> str:
        kind, v = self.t[self.i]
        if kind != "word":
            raise CypherError(f"expected a name, found {v or 'the end'}")
        self.i += 1
        return v

    def value(self):
        kind, v = self.t[self.i]
        self.i += 1
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "number":
            return float(v) if "." in v else int(v)
        if kind == "param":
            if v[1:] not in self.params:
                raise CypherError(f"no parameter {v}")
            return self.params[v[1:]]
        if (kind, v) == ("op", "["):
            items = []
            while not self.accept("]"):
                items.append(self.value())
                self.accept(",")
            return items
        raise CypherError(f"expected a value, found {v or 'the end'}")

    # patterns
    def node(self) -> tuple[str, DataFrame]:
        self.expect("(")
        kind, v = self.t[self.i]
        self.anonymous += 1
        name = self.word() if kind == "word" else f"_{self.anonymous}"
        label = self.word() if self.accept(":") else "Symbol"
        if label not in ("File", "Symbol"):
            raise CypherError(f"no label {label}")
        self.labels[name] = label
        table = self.g.files if label == "File" else self.g.symbols
        if self.accept("{"):
            while not self.accept("}"):
                p = self.word()
                self.expect(":")
                table = table.where(F.col(p).eqNullSafe(F.lit(self.value())))
                self.accept(",")
        self.expect(")")
        return name, table.select(*[F.col(c).alias(f"{name}.{c}") for c in table.columns])

    def relationship(self) -> str:
        """A type's name; one of them is a keyword elsewhere."""
        return "CONTAINS" if self.accept("CONTAINS") else self.word()

    def edges(self, kind: str) -> DataFrame:
        if kind == "IMPORTS":
            return self.g.imports.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
        if kind == "DEFINED_IN":
            return self.g.symbols.select(F.col("id").alias("src"), F.col("path").alias("dst"))
        if kind in ("CALLS", "USES", "INHERITS", "CONTAINS"):
            return self.g.edges(kind)
        raise CypherError(f"no relationship {kind}")

    def match(self) -> DataFrame:
        path = None
        if self.t[self.i][0] == "word" and self.peek("=", 1):
            path = self.word()
            self.expect("=")
        left, rows = self.node()
        if not (self.peek("-") or self.peek("<-")):
            if path:
                raise CypherError("a path has a relationship")
            return rows
        back = self.accept("<-")
        if not back:
            self.expect("-")
        self.expect("[")
        name = self.word() if self.t[self.i][0] == "word" else None
        kinds = []
        if self.accept(":"):
            kinds.append(self.relationship())
            while self.accept("|"):
                self.accept(":")
                kinds.append(self.relationship())
        span = None
        shortest = False
        if self.accept("*"):
            if self.t[self.i][0] == "word" and self.t[self.i][1].upper() == "SHORTEST":
                self.i += 1
                shortest = True
            low = self.value() if self.t[self.i][0] == "number" else 1
            high = low if not self.accept("..") else (self.value() if self.t[self.i][0] == "number" else traverse.MAX_DEPTH)
            span = (low, high)
        self.expect("]")
        forward = self.accept("->")
        if not forward:
            self.expect("-")
        right, others = self.node()
        if not kinds:
            raise CypherError("a relationship needs a type")
        if back and forward:
            raise CypherError("a relationship has one direction")
        parts = [self.edges(k) for k in kinds]
        columns = [c for c in parts[0].columns if c not in ("src", "dst") and all(c in p.columns for p in parts)]
        e = reduce(DataFrame.unionByName, [p.select("src", "dst", *columns) for p in parts])
        flipped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns)
        e = flipped if back else e if forward else e.unionByName(flipped)
        a, b = (f"{n}.{'path' if self.labels[n] == 'File' else 'id'}" for n in (left, right))
        ways = bool(path or (name and span))
        if span or path:
            starts = rows.select(F.col(f"`{a}`").alias("id"))
            if shortest:
                e = self._shortest(e, starts, others.select(F.col(f"`{b}`").alias("id")), *span)
            else:
                e = self._walks(e, starts, *(span or (1, 1)), ways)
            columns = []
        if ways:
            if "File" in (self.labels[left], self.labels[right]):
                raise CypherError("paths go from symbol to symbol")
            e, columns = self._with_nodes(e), ["nodes"]
            self.labels[name or path] = "WAY"
            name = name or path
        elif name:
            self.labels[name] = "REL"
        e = e.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), *[F.col(c).alias(f"{name or '_'}.{c}") for c in columns])
        rows = rows.join(e, F.col(f"`{a}`") == F.col("_src")).join(others, F.col("_dst") == F.col(f"`{b}`")).drop("_src", "_dst")
        if path:
            ends = [F.array(F.struct(*[F.col(f"`{n}.{c}`").alias(c) for c in self.g.symbols.columns])) for n in (left, right)]
            rows = rows.withColumn(f"{path}.", F.concat(ends[0], F.col(f"`{name}.nodes`"), ends[1]))
            self.labels[path] = "PATH"
        return rows

    def _walks(self, e: DataFrame, start: DataFrame, low: int, high: int, ways: bool = False) -> DataFrame:
        """(src, dst, way): what walks of low to high steps join, from the given starts.

        With ``ways`` a row a walk, and the nodes between its ends; else distinct ends.
        """
        self._bounds(low, high)
        steps = e.select("src", "dst").distinct()
        empty = F.array().cast("array<string>")
        ends = start.distinct().select(F.col("id").alias("src"), F.col("id").alias("at"), empty.alias("way"))
        found = None
        for hop in range(1, high + 1):
            way = F.concat("way", F.array("at")) if ways and hop > 1 else empty
            ends = ends.join(steps.withColumnsRenamed({"src": "at", "dst": "to"}), "at").select("src", F.col("to").alias("at"), way.alias("way")).distinct()
            if hop >= low:
                found = ends if found is None else found.unionByName(ends)
        return (found if ways else found.distinct()).withColumnRenamed("at", "dst")

    def _shortest(self, e: DataFrame, start: DataFrame, end: DataFrame, low: int, high: int) -> DataFrame:
        """(src, dst, way): one shortest walk for every start and end that one joins, by the smallest nodes between them."""
        self._bounds(low, high)
        if low != 1:
            raise CypherError("a shortest path begins at one step")
        steps = materialize(e.select("src", "dst").distinct())
        ends = start.distinct().select(F.col("id").alias("src"), F.col("id").alias("at"), F.array().cast("array<string>").alias("way"))
        seen = None
        for hop in range(1, high + 1):
            way = F.concat("way", F.array("at")) if hop > 1 else F.col("way")
            reached = ends.join(steps.withColumnsRenamed({"src": "at", "dst": "to"}), "at").groupBy("src", "to").agg(F.min(way).alias("way")).withColumnRenamed("to", "at")
            ends = materialize(reached if seen is None else reached.join(seen, ["src", "at"], "left_anti"))
            seen = ends if seen is None else seen.unionByName(ends)
        return seen.join(end.distinct().withColumnRenamed("id", "at"), "at", "left_semi").withColumnRenamed("at", "dst")

    @staticmethod
    def _bounds(low: int, high: int) -> None:
        if not 1 <= low <= high <= traverse.MAX_DEPTH:
            raise CypherError(f"a path has 1 to {traverse.MAX_DEPTH} steps")

    def _with_nodes(self, walks: DataFrame) -> DataFrame:
        """``walks`` with the symbols of ``way``, in order, as ``nodes``."""
        s = self.g.symbols
        node = F.struct(*[F.col(c) for c in s.columns])
        places = walks.select("src", "dst", "way", F.posexplode("way").alias("pos", "id")).join(s, "id")
        held = places.groupBy("src", "dst", "way").agg(F.array_sort(F.collect_list(F.struct("pos", node.alias("node")))).alias("held"))
        none = F.expr(f"CAST(array() AS array<{s.schema.simpleString()}>)")
        return walks.join(held, ["src", "dst", "way"], "left").select("src", "dst", F.coalesce(F.transform("held", lambda h: h["node"]), none).alias("nodes"))

    # expressions
    def operand(self) -> tuple[Column, str]:
        kind, v = self.t[self.i]
        if kind == "word" and v.lower() in ("lower", "upper", "tolower", "toupper") and self.peek("(", 1):
            self.i += 2
            c, text = self.operand()
            self.expect(")")
            return (F.lower(c) if "lower" in v.lower() else F.upper(c)), f"{v}({text})"
        if kind == "word" and v.lower() == "list_transform" and self.peek("(", 1):
            return self.transformed()
        if kind == "word" and self.labels.get(v) == "PATH":
            self.i += 1
            return F.col(f"`{v}.`"), v
        if kind == "word":
            name = self.word()
            if name not in self.labels:
                raise CypherError(f"no variable {name}")
            self.expect(".")
            p = self.word()
            return F.col(f"`{name}.{p}`"), f"{name}.{p}"
        value = self.value()
        return (F.lit(value) if not isinstance(value, list) else F.array(*map(F.lit, value))), str(value)

    def transformed(self) -> tuple[Column, str]:
        """``list_transform(nodes(e), n -> n.property)``"""
        self.i += 2
        if self.word().lower() != "nodes":
            raise CypherError("list_transform takes nodes(e)")
        self.expect("(")
        name = self.word()
        if self.labels.get(name) not in ("WAY", "PATH"):
            raise CypherError(f"{name} has no nodes")
        self.expect(")")
        self.expect(",")
        each = self.word()
        self.expect("->")
        if self.word() != each:
            raise CypherError(f"expected {each}")
        self.expect(".")
        p = self.word()
        nodes = F.col(f"`{name}.nodes`" if self.labels[name] == "WAY" else f"`{name}.`")
        self.expect(")")
        return F.transform(nodes, lambda n: n[p]), f"list_transform({name}.{p})"

    def condition(self) -> Column:
        c = self.conjunction()
        while self.accept("OR"):
            c = c | self.conjunction()
        return c

    def conjunction(self) -> Column:
        c = self.negation()
        while self.accept("AND"):
            c = c & self.negation()
        return c

    def negation(self) -> Column:
        if self.accept("NOT"):
            return ~self.negation()
        if self.accept("("):
            c = self.condition()
            self.expect(")")
            return c
        a, _ = self.operand()
        for op, make in (
            ("=", lambda x, y: x == y), ("<>", lambda x, y: x != y), ("<=", lambda x, y: x <= y), (">=", lambda x, y: x >= y),
            ("<", lambda x, y: x < y), (">", lambda x, y: x > y), ("CONTAINS", F.contains),
        ):
            if self.accept(op):
                return make(a, self.operand()[0])
        for op, make in (("STARTS", F.startswith), ("ENDS", F.endswith)):
            if self.accept(op):
                self.expect("WITH")
                return make(a, self.operand()[0])
        if self.accept("IN"):
            return a.isin(*self.value())
        if self.accept("IS"):
            none = not self.accept("NOT")
            self.expect("NULL")
            return a.isNull() if none else a.isNotNull()
        raise CypherError(f"expected a comparison, found {self.t[self.i][1] or 'the end'}")

    # the whole
    def returned(self, columns: list[str]) -> tuple[list[Column], list[Column]]:
        plain, counts = [], []
        while True:
            kind, v = self.t[self.i]
            if kind == "word" and v.lower() == "count" and self.peek("(", 1):
                self.i += 2
                if self.accept("*"):
                    c, text = F.count(F.lit(1)), "count(*)"
                else:
                    name = self.word()
                    if name not in self.labels:
                        raise CypherError(f"no variable {name}")
                    c, text = F.count(F.lit(1)), f"count({name})"
                self.expect(")")
                counts.append(c.alias(self.word() if self.accept("AS") else text))
            elif kind == "word" and v in self.labels and self.peek(".", 1) and self.peek("*", 2):
                self.i += 3
                plain += [F.col(f"`{c}`").alias(c) for c in columns if c.startswith(f"{v}.")]
            else:
                c, text = self.operand()
                plain.append(c.alias(self.word() if self.accept("AS") else text))
            if not self.accept(","):
                return plain, counts

    def run(self) -> DataFrame:
        self.expect("MATCH")
        rows = self.match()
        if self.accept("WHERE"):
            rows = rows.where(self.condition())
        self.expect("RETURN")
        distinct = self.accept("DISTINCT")
        plain, counts = self.returned(rows.columns)
        if counts:
            full = rows.groupBy(*plain).agg(*counts) if plain else rows.agg(*counts)
            names = full.columns
        else:
            names = rows.select(*plain).columns
            # what isn't returned stays for ORDER BY, unless rows are made distinct
            full = rows.select(*plain) if distinct else rows.select(*plain, *[F.col(f"`{c}`") for c in rows.columns if c not in names])
        if distinct:
            full = full.distinct()
        if self.accept("ORDER"):
            self.expect("BY")
            keys = []
            while True:
                name = self.word()
                if self.accept("."):
                    name = f"{name}.{self.word()}"
                key = F.col(f"`{name}`")
                keys.append(key.desc() if self.accept("DESC") else key.asc())
                self.accept("ASC")
                if not self.accept(","):
                    break
            full = full.orderBy(*keys)
        if self.accept("SKIP"):
            full = full.offset(self.value())
        if self.accept("LIMIT"):
            full = full.limit(self.value())
        if self.t[self.i][0] != "end":
            raise CypherError(f"cannot use {self.t[self.i][1]} here")
        return full.select(*[F.col(f"`{n}`") for n in names])


def cypher(graph: Graph, text: str, **params) -> DataFrame:
    """The rows of a query over ``graph``."""
    return Compiler(graph, text, params).run()

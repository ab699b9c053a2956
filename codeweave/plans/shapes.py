"""Source files in several languages, one for each path of the bound graph, and the facts that extraction must find in them.

A shape has the lines at the top of a file and those that each symbol of the path adds, with {pk}, {a} and {b} for numbers
that follow from its key; and the facts, by line. The text is made by Spark SQL, the facts by the oracle: they meet
only in the result.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Shape:
    suffix: str
    top: tuple[str, ...]
    lines: tuple[str, ...]
    #: (what, name, kind, first line, last line) with lines counted from 1 within what a symbol adds; 0: none.
    facts: tuple[tuple[str, str, str, int, int], ...]
    imports: tuple[str, ...] = ()


_CLASS_WITH_METHOD = (("symbol", "C{pk}", "class", 1, 3), ("symbol", "m{pk}", "method", 2, 2), ("contains", "C{pk}", "m{pk}", 0, 0), ("call", "n{a}", "m{pk}", 2, 2), ("base", "B{b}", "C{pk}", 0, 0))

SHAPES = {
    "java": Shape(
        ".java", ("import harbour.yard.Winch;",),
        ("class C{pk} extends B{b} {", "  @Override @Named(value = {1, 2}) public void m{pk}(T x) { n{a}(x); }", "}"),
        _CLASS_WITH_METHOD, ("harbour.yard.Winch",),
    ),
    "typescript": Shape(
        ".ts", ("import { Winch } from './winch';", "// no(); function none() {}"),
        ("export class C{pk} extends B{b} {", "  m{pk}(x: T{b}) { return n{a}<T{b}>(x); }", "}"),
        (*_CLASS_WITH_METHOD, ("use", "T{b}", "C{pk}", 0, 0)), ("./winch",),
    ),
    "go": Shape(
        ".go", ("package harbour", "", 'import "fmt"'),
        ("type C{pk} struct { x int }", "func (c *C{pk}) m{pk}(x int) int { return n{a}(x) }"),
        (("symbol", "C{pk}", "type", 1, 1), ("symbol", "m{pk}", "method", 2, 2), ("call", "n{a}", "m{pk}", 2, 2)), ("fmt",),
    ),
    "php": Shape(
        ".php", ("<?php",),
        ("class C{pk} extends B{b} implements I{b} {", "  private function m{pk}(T{b} $x) { return $this->n{a}($x); }", "}"),
        (*_CLASS_WITH_METHOD, ("base", "I{b}", "C{pk}", 0, 0), ("use", "T{b}", "C{pk}", 0, 0)),
    ),
    "cpp": Shape(
        ".cpp", ("#include <vector>", "/* struct No { void none() {} }; */"),
        ("struct C{pk} { int m{pk}(int x) { return x; } };",),
        (("symbol", "C{pk}", "struct", 1, 1), ("symbol", "m{pk}", "function", 1, 1), ("contains", "C{pk}", "m{pk}", 0, 0)),
    ),
}


def _filled(text: str) -> str:
    """SQL for a text with its numbers."""
    quoted = "'" + text.replace("'", "''") + "'"
    for mark, number in (("{pk}", "pk"), ("{a}", "(pk * 7 + 3) % 1000"), ("{b}", "pk % 7")):
        quoted = f"replace({quoted}, '{mark}', CAST({number} AS STRING))" if mark in text else quoted
    return quoted


def _path(shape: Shape) -> str:
    return f"replace(path, '.py', '{shape.suffix}')"


def sources(shape: Shape) -> str:
    """(path, content) in Spark SQL, from {keyed}."""
    doubled = lambda sql: sql.replace("{", "{{").replace("}", "}}")  # noqa: E731  # spark.sql() fills braces
    body = doubled(" || chr(10) || ".join(map(_filled, shape.lines)) + " || chr(10)")
    top = doubled(" || ".join(f"{_filled(t)} || chr(10)" for t in shape.top))
    return f"""
        SELECT {_path(shape)} AS path, CAST({top} || concat_ws('', transform(array_sort(collect_list(struct(pk, text))), x -> x.text)) AS BINARY) AS content
        FROM (SELECT path, pk, {body} AS text FROM {{keyed}}) GROUP BY path
    """


def expected(shape: Shape) -> str:
    """The facts in DuckDB's SQL, from sym."""
    line = lambda n: f"CAST({len(shape.top) + n} + {len(shape.lines)} * r AS BIGINT)" if n else "CAST(NULL AS BIGINT)"
    rows = [f"SELECT '{what}' AS what, path, {_filled(name)} AS name, {_filled(kind)} AS kind, {line(first)} AS line_start, {line(last)} AS line_end FROM p" for what, name, kind, first, last in shape.facts]
    rows += [f"SELECT DISTINCT 'import', path, '{name}', NULL, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p" for name in shape.imports]
    return f", p AS (SELECT {_path(shape)} AS path, pk, row_number() OVER (PARTITION BY path ORDER BY pk) - 1 AS r FROM sym) " + " UNION ALL ".join(rows)

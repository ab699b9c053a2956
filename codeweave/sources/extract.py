"""One source file -> one nested row of symbols and raw references. Offsets are bytes.

Python goes through the standard library's parser; every other language (and Python that doesn't parse)
through a table-driven scanner. Files of unknown languages give no row.
"""

from __future__ import annotations

import ast
import ctypes
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from codeweave.functions.text import LANGUAGES as EXTENSIONS
from codeweave.schema import ENCLOSING_TYPES, EXTRACT_VERSION
from codeweave.sources.languages import LANGUAGES, NOT_CALLED, Language

_SYMBOL = "id string, name string, kind string, path string, lang string, line_start bigint, line_end bigint, start_byte bigint, end_byte bigint, signature string, doc string, visibility string, modifiers string"
EXTRACT_DDL = (
    f"cache_key string, path string, lang string, hash string, symbols array<struct<{', '.join(c.replace(' ', ':', 1) for c in _SYMBOL.split(', '))}>>, "
    "contains array<struct<parent:string,child:string>>, inherits array<struct<sub:string,base:string>>, imports array<string>, "
    "callsites array<struct<caller_id:string,callee_name:string,line:bigint>>, uses array<struct<src:string,type_name:string>>"
)
FACTS_DDL = "path string, what string, name string, kind string, line_start bigint, line_end bigint"
_VISIBILITY = frozenset({"public", "private", "protected"})
_MODIFIERS = frozenset({"static", "async", "abstract", "final", "readonly"})


def detect_language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return EXTENSIONS.get(name[dot:].lower()) if dot > 0 else None


class File:
    """A file under extraction."""

    def __init__(self, path: str, lang: str, source: bytes):
        self.path, self.lang, self.source = path, lang, source
        self.lines = [0, *(m.end() for m in re.finditer(b"\n", source))]
        self.symbols: dict[int, dict] = {}  # by start byte: ids never collide
        self.inherits: list[tuple[str, str]] = []
        self.imports: list[str] = []
        self.calls: list[tuple[int, str]] = []
        self.uses: list[tuple[int, str]] = []

    def line(self, byte: int) -> int:
        return bisect_right(self.lines, byte)

    def text(self, start: int, end: int) -> str:
        return self.source[start:end].decode("utf-8", "replace")

    def add(self, name: str, kind: str, start: int, end: int, doc: str, visibility: str, modifiers: set[str]) -> None:
        self.symbols.setdefault(
            start,
            {
                "id": f"{self.path}#{start}", "name": name, "kind": kind, "path": self.path, "lang": self.lang, "line_start": self.line(start),
                "line_end": self.line(max(start, end - 1)), "start_byte": start, "end_byte": end, "signature": self.text(start, end).split("\n", 1)[0].strip(),
                "doc": doc, "visibility": visibility, "modifiers": ",".join(sorted(modifiers)),
            },
        )

    def row(self) -> dict:
        symbols = [self.symbols[k] for k in sorted(self.symbols)]
        holder = _holders(symbols)
        types = _holders([s for s in symbols if s["kind"] in ENCLOSING_TYPES])
        contains = []
        for s in symbols:
            around = holder(s["start_byte"], s["id"])
            if around:
                contains.append({"parent": around["id"], "child": s["id"]})
        calls = []
        for byte, name in self.calls:
            if caller := holder(byte, None):
                calls.append({"caller_id": caller["id"], "callee_name": name, "line": self.line(byte)})
        uses: dict[tuple[str, str], None] = {}
        for byte, name in self.uses:
            around, last = types(byte, None), re.split(r"[\\/]", name)[-1]
            if around and last and last != around["name"]:
                uses[around["id"], last] = None
        first = {}
        for s in symbols:
            if s["kind"] in ("class", "struct", "interface"):
                first.setdefault(s["name"], s["id"])
        digest = hashlib.sha1(self.source).hexdigest()
        return {
            "cache_key": cache_key(self.path, digest), "path": self.path, "lang": self.lang, "hash": digest, "symbols": symbols, "contains": contains,
            "inherits": [{"sub": first[sub], "base": base} for sub, base in self.inherits if sub in first], "imports": [i for i in self.imports if i],
            "callsites": calls, "uses": [{"src": a, "type_name": b} for a, b in uses],
        }


def cache_key(path: str, digest: str, version: int = EXTRACT_VERSION) -> str:
    return hashlib.sha1(f"v{version}:{path}@{digest}".encode()).hexdigest()


def _holders(symbols: list[dict]):
    """byte, excluded id -> the innermost symbol around the byte; spans nest, so parents are followed outwards."""
    ordered = sorted(symbols, key=lambda s: (s["start_byte"], -s["end_byte"]))
    starts = [s["start_byte"] for s in ordered]
    parent: list[int] = []
    open_: list[int] = []
    for i, s in enumerate(ordered):
        while open_ and ordered[open_[-1]]["end_byte"] <= s["start_byte"]:
            open_.pop()
        parent.append(open_[-1] if open_ else -1)
        open_.append(i)

    def find(byte: int, excluded: str | None) -> dict | None:
        i = bisect_right(starts, byte) - 1
        while i >= 0 and (ordered[i]["end_byte"] <= byte or ordered[i]["id"] == excluded):
            i = parent[i]
        return ordered[i] if i >= 0 else None

    return find


def _underscored(name: str) -> str:
    return "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"


#: Bytes of Python that are parsed at once: a tree is a hundred times its text.
PART = 1 << 18
_TOP = re.compile(rb"^(?:class|def|async|@)\b", re.MULTILINE)
_WHOLE = re.compile(rb"\A.*(?:\n.*)?coding[:=]|\r(?!\n)")


def _trees(source: bytes) -> Iterator[tuple[int, ast.Module]]:
    """(lines before, tree) of runs of top-level statements. A run that doesn't parse was cut within one, and gets longer.

    Files with an encoding of their own or lines that end in a mere carriage return are one run.
    """
    at, lines, size = 0, 0, len(source) if _WHOLE.search(source) else PART
    while True:
        cut = _TOP.search(source, at + size)
        end = cut.start() if cut else len(source)
        try:
            tree = ast.parse(source[at:end])
        except SyntaxError:
            if end == len(source):
                raise
            size *= 2
            continue
        yield lines, tree
        if end == len(source):
            return
        lines += source.count(b"\n", at, end)
        at, size = end, PART


def _python(f: File) -> None:
    rows = f.source.split(b"\n")
    for before, tree in _trees(f.source):
        _python_part(f, rows, before, tree)
    f.calls.sort()


def _python_part(f: File, rows: list[bytes], before: int, tree: ast.Module) -> None:
    byte = lambda n: f.lines[before + n.lineno - 1] + n.col_offset

    def doc(node) -> str:
        if node.decorator_list:
            return ""
        found, i = [], before + node.lineno - 2
        while i >= 0 and (not rows[i].strip() or rows[i].lstrip().startswith(b"#")):
            if rows[i].strip():
                found.append(rows[i].strip().decode("utf-8", "replace"))
            i -= 1
        return "\n".join(reversed(found))

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            end = f.lines[before + node.end_lineno - 1] + node.end_col_offset
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            f.add(node.name, kind, byte(node), end, doc(node), _underscored(node.name), {"async"} if isinstance(node, ast.AsyncFunctionDef) else set())
        if isinstance(node, ast.ClassDef):
            f.inherits += [(node.name, b.id) for b in node.bases if isinstance(b, ast.Name)]
        elif isinstance(node, ast.Import):
            f.imports += [a.name for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom) and node.module:
            f.imports.append(node.module)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                f.calls.append((byte(node.func), node.func.id))
            elif isinstance(node.func, ast.Attribute):
                f.calls.append((f.lines[before + node.func.end_lineno - 1] + node.func.end_col_offset - len(node.func.attr.encode()), node.func.attr))
        hints = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            hints = [node.returns, *(x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x is not None)]
        elif isinstance(node, ast.AnnAssign):
            hints = [node.annotation]
        f.uses += [(byte(h), h.id) for h in hints if isinstance(h, ast.Name)]


_NOT_NEWLINE = re.compile(r"[^\n]")


class Mask:
    """A source as one character a byte: ``plain`` has comments and the contents of literals blanked, ``code`` comments alone."""

    def __init__(self, source: bytes, spec: Language):
        self.text = source.decode("latin-1")
        self.spec = spec
        self._plain, self._code = list(self.text), list(self.text)
        self.comments: list[tuple[int, int]] = []
        self._closers = {**dict(spec.block_comments), **dict.fromkeys(spec.line_comments, "\n")}
        openers = [*sorted(map(re.escape, self._closers), key=len, reverse=True), *(o for o, _ in spec.literals), f"[{re.escape(spec.quotes)}]"]
        self._token = re.compile("|".join(openers + [r"[{}]"] * spec.templates))
        if spec.outside:  # what isn't between the tags is no code
            self._outside()
        self._code_from(0, False)
        if spec.opaque:
            self._tokens(spec.opaque)
        self.plain, self.code = "".join(self._plain), "".join(self._code)

    def _blank(self, start: int, end: int, *masks: list[str]) -> None:
        blank = _NOT_NEWLINE.sub(" ", self.text[start:end])
        for mask in masks:
            mask[start : start + len(blank)] = blank

    def _tokens(self, head: re.Pattern) -> None:
        plain, at = "".join(self._plain), 0
        while m := head.search(plain, at):
            depth, at = 0, len(plain)
            for b in re.compile(r"[(){}\[\]]").finditer(plain, m.end()):
                depth += 1 if b[0] in "({[" else -1
                if not depth:
                    at = b.end()
                    break
            self._blank(m.end() + 1, at - 1, self._plain)

    def _outside(self) -> None:
        opened, closed = self.spec.outside
        at, kept = 0, []
        while (start := self.text.find(opened, at)) >= 0:
            end = self.text.find(closed, start)
            kept.append((start, len(self.text) if end < 0 else end))
            at = kept[-1][1]
        at = 0
        for start, end in [*kept, (len(self.text), len(self.text))]:
            self._blank(at, start, self._plain, self._code)
            at = end
        self.text = "".join(self._code)

    def _code_from(self, at: int, nested: bool) -> int:
        """Reads code; where it is nested in a template, up to the brace that closes it. Where reading ended."""
        depth = 0
        while m := self._token.search(self.text, at):
            begin, opened = m.start(), m[0]
            if opened in "{}":
                depth += 1 if opened == "{" else -1
                at = m.end()
                if nested and depth < 0:
                    return at
            elif opened in self._closers:
                at = self._comment(begin, opened)
            elif opened == "`" and self.spec.templates:
                at = self._template(m.end())
            else:
                at = self._literal(begin, opened)
            at = max(at, begin + 1)
        return len(self.text)

    def _comment(self, begin: int, opened: str) -> int:
        closer = self._closers[opened]
        close = self.text.find(closer, begin + len(opened))
        end = len(self.text) if close < 0 else close + (0 if closer == "\n" else len(closer))
        self.comments.append((begin, end))
        self._blank(begin, end, self._plain, self._code)
        return end

    def _template(self, at: int) -> int:
        while at < len(self.text):
            c = self.text[at]
            if c == "`":
                return at + 1
            if self.text.startswith("${", at):
                at = self._code_from(at + 2, True)
                continue
            self._blank(at, at + 1 + (c == "\\"), self._plain)
            at += 1 + (c == "\\")
        return at

    def _literal(self, begin: int, opened: str) -> int:
        for opener, whole in self.spec.literals:
            if re.fullmatch(opener, opened) and (m := whole.match(self.text, begin)):
                self._blank(m.start() + 1, m.end() - 1, self._plain)
                return m.end()
        if opened not in self.spec.quotes:
            return begin + len(opened)
        end = begin + 1
        while end < len(self.text) and self.text[end] != opened and (opened == "`" or self.text[end] != "\n"):
            end += 2 if self.text[end] == "\\" else 1
        self._blank(begin + 1, end, self._plain)
        return end + 1


def _after_type_parameters(plain: str, at: int) -> int:
    """The place after ``<...>``, if that is next; bounds may hold braces and arrows."""
    while at < len(plain) and plain[at].isspace():
        at += 1
    if at >= len(plain) or plain[at] != "<":
        return at
    depth = 0
    for m in re.compile(r"=>|->|[<>;]").finditer(plain, at):
        depth += {"<": 1, ">": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return at


_INDENT = re.compile(r"[ \t]*")


def _block_end(plain: str, head: re.Match, start: int, style: str) -> int:
    at = head.end()
    if style == "braces":
        depth = 0
        for m in re.compile(r"[{};()]").finditer(plain, _after_type_parameters(plain, head.end("name"))):
            c = m[0]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == ";" and depth <= 0:
                return m.end()
            elif c == "{" and depth <= 0:
                level = 0
                for b in re.compile(r"[{}]").finditer(plain, m.start()):
                    level += 1 if b[0] == "{" else -1
                    if not level:
                        return b.end()
                return len(plain)
        return len(plain)
    if style == "statement":
        semicolon = plain.find(";", at)
        return len(plain) if semicolon < 0 else semicolon + 1
    line = plain.rfind("\n", 0, start) + 1
    indent = _INDENT.match(plain, line).end() - line if plain[line:start].strip() == "" else 0
    if style == "end":
        m = re.compile(rf"^[ \t]{{0,{indent}}}end\b", re.MULTILINE).search(plain, at)
        return m.end() if m else len(plain)
    m = re.compile(rf"^[ \t]{{0,{indent}}}\S", re.MULTILINE).search(plain, plain.find("\n", at) + 1 or len(plain))
    end = m.start() if m else len(plain)
    while end and plain[end - 1].isspace():
        end -= 1
    return end


def _scan(f: File, spec: Language) -> None:
    mask = Mask(f.source, spec)
    plain, code, comments = mask.plain, mask.code, mask.comments
    comment_at = {e: s for s, e in comments}
    name_of = lambda m: f.text(m.start("name"), m.end("name"))

    def doc(start: int) -> str:
        found = []
        while True:
            before = start
            while before and plain[before - 1].isspace() and before not in comment_at:
                before -= 1
            if before not in comment_at:
                return "\n".join(reversed(found))
            start = comment_at[before]
            found.append(f.text(start, before))

    heads = []
    for kind, pattern in spec.heads:
        for m in pattern.finditer(plain):
            if name_of(m) in NOT_CALLED:
                continue
            begin = m.start("mods") if m["mods"] is not None else m.start()
            while begin < m.end() and plain[begin].isspace():
                begin += 1
            words = m["mods"].split() if m["mods"] else []
            while words and words[0] in ("export", "default"):  # the statement around, not the definition
                begin = plain.index(words[0], begin) + len(words.pop(0))
                while plain[begin].isspace():
                    begin += 1
            heads.append((begin, kind, m, words))
    heads.sort(key=lambda h: h[0])
    spans = [(b, _block_end(plain, m, b, spec.block), k, m, w) for b, k, m, w in heads]
    types = [(b, e) for b, e, k, _, _ in spans if k in ENCLOSING_TYPES]
    type_starts, furthest = [b for b, _ in types], list(accumulate((e for _, e in types), max))
    named = set()
    for begin, end, kind, m, words in spans:
        before = bisect_left(type_starts, begin)
        inside = before > 0 and furthest[before - 1] > begin
        if kind in spec.in_types and not inside:
            continue
        if f.lang == "php" and kind == "function" and inside:
            kind = "method"
        visibility = next((w for w in words if w in _VISIBILITY), "public")
        name = name_of(m)
        if f.lang == "python":
            visibility = _underscored(name)
        f.add(name, kind, begin, end, doc(begin), visibility, {w for w in words if w in _MODIFIERS})
        named.add(m.start("name"))
    for p in spec.imports:
        f.imports += [name_of(m).strip("\"'`") for m in p.finditer(code)]
    for p in spec.bases:
        for m in p.finditer(plain):
            bases = m["names"].split(",") if "names" in p.groupindex else [m["name"]]
            f.inherits += [(m["sub"], b.strip()) for b in bases if "\\" not in b and b.strip()]
    for p in spec.calls:
        f.calls += [(m.start("name"), name_of(m)) for m in p.finditer(plain) if m.start("name") not in named and name_of(m) not in NOT_CALLED]
    for p in spec.uses:
        f.uses += [(m.start("name"), name_of(m)) for m in p.finditer(plain) if name_of(m) not in NOT_CALLED]
    f.calls.sort()
    f.uses.sort()


def extract_source(path: str, source: bytes) -> dict | None:
    """The extract row of a file, or None for an unknown language."""
    lang = detect_language(path)
    if lang is None:
        return None
    f = File(path, lang, source)
    if lang == "python":
        try:
            _python(f)
            return f.row()
        except (SyntaxError, ValueError, RecursionError):
            f = File(path, lang, source)
    _scan(f, LANGUAGES[lang])
    return f.row()


#: Bytes of sources whose rows are one Arrow batch; a longer file has its own.
AT_ONCE = 1 << 18
#: Rows of one Arrow batch, where a file gives many.
ROWS = 1 << 14


def _trim() -> None:
    """Memory of a large file goes back to the system before the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _of_files(files: DataFrame, ddl: str, rows_of: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """(path, content) -> the rows that ``rows_of`` makes of each file's extract row, one file in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small: list[dict] = []
            held = 0
            for path, content in zip(b.column("path"), b.column("content")):
                source = content.as_py()
                row = extract_source(path.as_py(), source) if path.is_valid and source is not None else None
                if row is not None:
                    for out in rows_of(row):
                        small.append(out)
                        if len(small) >= ROWS:
                            yield pa.RecordBatch.from_pylist(small, schema=schema)
                            small = []
                    held += len(source)
                if held >= AT_ONCE:
                    out = pa.RecordBatch.from_pylist(small, schema=schema)
                    small, row, source, held = [], None, None, 0
                    yield out
                    del out
                    _trim()
            yield pa.RecordBatch.from_pylist(small, schema=schema)

    return files.select("path", "content").mapInArrow(work, ddl)


def extract_files(files: DataFrame) -> DataFrame:
    """(path, content) -> extract rows, one file in memory at a time; unknown languages give none."""
    return _of_files(files, EXTRACT_DDL, lambda row: [row])


def facts(row: dict) -> Iterator[dict]:
    """What an extract row holds, by names instead of ids: each id is looked up once, whatever the symbols of the file."""
    names = {s["id"]: s["name"] for s in row["symbols"]}

    def fact(what: str, name: str, kind: str | None, first: int | None = None, last: int | None = None) -> dict:
        return {"path": row["path"], "what": what, "name": name, "kind": kind, "line_start": first, "line_end": last}

    for s in row["symbols"]:
        yield fact("symbol", s["name"], s["kind"], s["line_start"], s["line_end"])
    for c in row["contains"]:
        yield fact("contains", names[c["parent"]], names[c["child"]])
    for i in row["inherits"]:
        yield fact("base", i["base"], names[i["sub"]])
    for i in row["imports"]:
        yield fact("import", i, None)
    for c in row["callsites"]:
        yield fact("call", c["callee_name"], names[c["caller_id"]], c["line"], c["line"])
    for u in row["uses"]:
        yield fact("use", u["type_name"], names[u["src"]])


def extract_facts(files: DataFrame) -> DataFrame:
    """(path, content) -> :func:`facts`, a row each: what, name, kind (or the name at the other end), line_start, line_end."""
    return _of_files(files, FACTS_DDL, facts)

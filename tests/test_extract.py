import pytest

from codeweave.sources.extract import extract_source
from codeweave.sources.tree import walk


def names(row, kind=None):
    return {s["name"] for s in row["symbols"] if kind is None or s["kind"] == kind}


def by_name(row):
    return {s["name"]: s for s in row["symbols"]}


def callees(row):
    return {c["callee_name"] for c in row["callsites"]}


def uses(row):
    return {u["type_name"] for u in row["uses"]}


def sample(name):
    from tests.conftest import SAMPLE

    return extract_source(name, (SAMPLE / name).read_bytes())


def test_python_symbols_and_references():
    row = sample("ledger.py")
    assert names(row, "class") == {"Account", "Savings"}
    assert names(row, "function") == {"label", "round_cents", "deposit"}
    assert row["inherits"] == [{"sub": by_name(row)["Savings"]["id"], "base": "Account"}]
    assert row["imports"] == ["storage"]
    assert callees(row) == {"int", "open_book", "append", "round_cents"}
    assert {c["child"] for c in row["contains"]} == {by_name(row)["label"]["id"], by_name(row)["deposit"]["id"]}
    assert next(c["line"] for c in row["callsites"] if c["callee_name"] == "append") == 21


def test_typescript_and_go():
    ts, go = sample("ticket.ts"), sample("ferry.go")
    assert names(ts, "class") == {"Counter"} and names(ts, "method") == {"sell"} and names(ts, "interface") == {"Fare"}
    assert ts["imports"] == ["./ledger"] and callees(ts) == {"price"} and uses(ts) == {"Fare", "Savings"}
    from tests.conftest import SAMPLE

    assert (SAMPLE / "ticket.ts").read_bytes()[by_name(ts)["Counter"]["start_byte"] :].startswith(b"class Counter")  # not the export around it
    assert names(go) == {"Depart", "board"} and callees(go) == {"board"} and go["imports"] == []


def test_php():
    source = (
        "<?php\nnamespace Harbour\\Yard;\nuse Harbour\\Tools\\Winch;\n\ninterface Lifts {}\n\nfinal class Crane extends Machine implements Lifts {\n"
        "    protected ?Winch $winch = null;\n"
        "    final public function lift(Load $load, int $metres = 3): Height {\n        return $this->turn($load)->by(Gear::low());\n    }\n"
        "    private static function turn($what) { return new Cable($what); }\n}\n"
    )
    row = extract_source("yard/Crane.php", source.encode())
    assert names(row, "class") == {"Crane"} and names(row, "interface") == {"Lifts"} and names(row, "method") == {"lift", "turn"}
    assert {i["base"] for i in row["inherits"]} == {"Machine", "Lifts"}
    assert row["imports"] == ["Harbour\\Tools\\Winch"]
    assert {"turn", "by"} <= callees(row) and "Cable" not in callees(row)
    assert {"Load", "Height", "Gear", "Cable"} <= uses(row) and "Crane" not in uses(row)
    assert by_name(row)["turn"]["visibility"] == "private" and by_name(row)["turn"]["modifiers"] == "static"
    assert by_name(row)["lift"]["visibility"] == "public"


def test_python_type_uses_skip_the_class_itself():
    row = extract_source("d.py", b"class Dock:\n    ...\n\n\nclass Yard:\n    near: list[Dock]\n\n    def widen(self, by: int, other: Yard) -> Dock:\n        return self.near[by]\n")
    assert uses(row) == {"Dock", "int"}


@pytest.mark.parametrize(
    ("path", "source", "expected"),
    [
        ("lib.c", "static double area(double w, double h)\n{\n    return w * h;\n}\n\nstruct Hull { double beam; };\n", {"area", "Hull"}),
        ("svc.rb", "class Buoy\n  def float_at(depth)\n    depth + 1\n  end\nend\n", {"Buoy", "float_at"}),
        ("a.rs", "pub enum Wind { Calm, Gale }\n\nstruct Sail { area: f32 }\n\npub fn trim(s: &Sail) -> f32 { reef(s.area) }\n", {"Wind", "Sail", "trim"}),
        ("A.java", "final class Anchor implements Heavy {\n  private int weigh(int n) { return n; }\n}\ninterface Heavy { int weigh(int n); }\n", {"Anchor", "weigh", "Heavy"}),
        ("k.kt", "class Rope { fun splice(n: Int) { knot(n) } }", {"Rope", "splice"}),
        ("c.cs", "public class Oar { internal static int Length(int of) { return of; } }", {"Oar", "Length"}),
        ("w.swift", "class Mast { func raise(_ flag: Flag) { } }", {"Mast", "raise"}),
        ("s.scala", "class Deck { def scrub(n: Int) = n }", {"Deck", "scrub"}),
        ("q.lua", "local function drift(x)\n return x + 1\nend\n", {"drift"}),
        ("b.sh", "hoist() {\n echo up\n}\n", {"hoist"}),
        ("z.sql", "CREATE FUNCTION knots(mph float) RETURNS float AS 'select 1';", {"knots"}),
    ],
)
def test_other_languages(path, source, expected):
    assert names(extract_source(path, source.encode())) == expected


def test_go_types_in_one_block_have_their_own_ids():
    row = extract_source("t.go", b"package a\ntype (\n\tA struct { x int }\n\tB struct { y int }\n)\n")
    assert len({s["id"] for s in row["symbols"]}) == len(row["symbols"]) == 2


def test_visibility_and_modifiers():
    py = by_name(extract_source("v.py", b"async def sail():\n    ...\n\n\ndef _bail(n):\n    return n\n\n\ndef __enter__():\n    ...\n\n\ndef moor(): ...\n"))
    assert [py[n]["visibility"] for n in ("sail", "_bail", "__enter__", "moor")] == ["public", "private", "public", "public"]
    assert py["sail"]["modifiers"] == "async"
    ts = by_name(extract_source("v.ts", b"class Helm {\n  protected steer(by: number) { return by; }\n  static async straight() { return 0; }\n  private hold() {}\n}\n"))
    assert [ts[n]["visibility"] for n in ("steer", "straight", "hold")] == ["protected", "public", "private"] and "static" in ts["straight"]["modifiers"]


def test_comments_before_a_definition_and_byte_offsets():
    source = "# über\n\n# second\n\ndef f():\n    return 'x'\n".encode()
    s = by_name(extract_source("u.py", source))["f"]
    assert s["doc"] == "# über\n# second"
    assert source[s["start_byte"] : s["end_byte"]].startswith(b"def f()")
    assert by_name(extract_source("a.java", b"class A {\n  // adds\n  int add() { return 1; }\n}"))["add"]["doc"] == "// adds"


def test_strings_and_comments_hide_code():
    row = extract_source("a.js", b"// function no() {}\nconst s = 'function no2() {}';\nfunction yes() { call('x(') }\n")
    assert names(row) == {"yes"} and callees(row) == {"call"}


@pytest.mark.parametrize(
    ("path", "source", "expected"),
    [
        ("hull.cpp", "namespace sea {\ntemplate <typename T, class U>\nT deeper(T a, U b) { return dive(a); }\n\ntemplate<class Hull>\nclass Ship : public Vessel {\n public:\n  int sail(int k) const { return row(k); }\n};\n"
            "enum class Flag { Red, Blue };\nShip<int>::Ship(int n) : n_{n}, m_(n) { launch(); }\nint Ship<int>::speed() const noexcept {\n  auto s = R\"x(class No { int f() { } })x\";\n  int big = 1'000'000;\n"
            "  return knots(big);\n}\nauto Harbour::depth() -> int { return 3; }\n}\n", ["deeper", "Ship", "sail", "Flag", "Ship", "speed", "depth"]),
        ("knot.js", "function tie() { const re = /function no() {/; return re.test('x') }\nconst half = a / b; const third = c / d;\nfunction last(q) { return /[/}]/.test(q) ? after(`${q} {`) : 0 }\n", ["tie", "last"]),
        ("rope.ts", "class Coil<T extends { a: 1 }> extends Base {\n  take(x: T): number { return weigh(x); }\n}\nfunction id<K extends () => void>(k: K) { return k; }\n", ["Coil", "take", "id"]),
        ("mail.php", "<html> function nope() { } <?php\nclass Mail { public function body() { $t = <<<TXT\nclass no { function yes() { } }\nTXT;\n return send($t); } }\n?> function neither() {} <?php function both() { return <<<'X'\n { ' \"\n X; }\n",
            ["Mail", "body", "both"]),
        ("quote.rs", "fn quote(c: char) -> bool { c == '\"' || c == '\\'' }\nfn life<'a>(x: &'a str) -> &'a str { trim(x) }\nfn raw() -> &'static str { r#\"fn no() { \" }\"# }\nstruct Last { a: u8 }\n", ["quote", "life", "raw", "Last"]),
    ],
)
def test_literals_scopes_and_type_parameters(path, source, expected):
    row = extract_source(path, source.encode())
    assert [s["name"] for s in row["symbols"]] == expected
    ends = {s["name"]: source.encode()[s["end_byte"] - 1 : s["end_byte"]] for s in row["symbols"]}
    assert set(ends.values()) == {b"}"}
    if path == "rope.ts":
        assert [i["base"] for i in row["inherits"]] == ["Base"] and callees(row) == {"weigh"}
    if path == "knot.js":
        assert callees(row) == {"test", "after"}


@pytest.mark.parametrize(
    ("path", "source", "symbols", "called"),
    [
        ("Dock.java", '@Deprecated class Dock {\n  @Override public void moor() { tie(); }\n  @SuppressWarnings({"a", "b(c)"})\n  @Inject private <T> T load(T t) { return lift(t); }\n}\n@interface Marked { }\n', ["Dock", "moor", "load"], {"tie", "lift"}),
        ("rig.ts", "function rig(a: Hull) { return fit<Sail>(a) && i < n && m > (k); }\nconst all = pick<Map<string, Mast[]>>(x);\n", ["rig"], {"fit"}),
        ("vec.cpp", "struct Vec { void push(T x){ grow(x); } int size() const { return n; } };\nclass Log { public: void add(int v) { n += v; } private: int n; };\nint main() { if (a) { run(b); } else if (c) { } for (;;) { } return 0; }\n", ["Vec", "push", "size", "Log", "add", "main"], set()),
        ("h.sh", "function haul { pull; }\nlower() { :; }\nfunction hoist() {\n  haul\n}\n", ["haul", "lower", "hoist"], set()),
        ("m.rs", "macro_rules! sails { ($n:ident) => { fn $n() {} fn hidden() { lost(); } }; }\nfn shown() { println!(\"{}\", inside(1)); outside(vec![made(2)]); }\n", ["shown"], {"outside"}),
    ],
)
def test_one_line_members_type_arguments_and_macros(path, source, symbols, called):
    row = extract_source(path, source.encode())
    assert [s["name"] for s in row["symbols"]] == symbols
    assert callees(row) == called
    if path == "Dock.java":
        spans = {s["name"]: source[s["start_byte"] : s["end_byte"]] for s in row["symbols"]}
        assert spans["moor"] == "@Override public void moor() { tie(); }" and spans["load"].startswith("@SuppressWarnings") and by_name(row)["load"]["visibility"] == "private"


def test_calls_inside_templates_count():
    row = extract_source("t.js", b"function greet(n) { return `hi { ${name(`of ${title(n)} (`)} function x() {}`; }\n")
    assert names(row) == {"greet"} and callees(row) == {"name", "title"}


def test_python_that_does_not_parse_is_scanned():
    row = extract_source("bad.py", b"def f(:\n  pass\n\ndef g():\n  return h()\n")
    assert names(row) == {"f", "g"} and callees(row) == {"h"}


def test_unknown_language():
    assert extract_source("README.md", b"x") is None and extract_source(".py", b"x") is None


def test_walk_finds_underscored_files_and_skips_folders(tmp_path):
    for p in ("__init__.py", "_private.py", "a/b.go", "node_modules/x.js", ".hid/y.py", "build/z.py", "notes.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert [r for _, r in walk(str(tmp_path))] == ["__init__.py", "_private.py", "a/b.go"]


def test_every_file_is_in_one_branch(spark, tmp_path):
    """However many folders are read apart, the files are those of the walk, each once."""
    from codeweave.sources.tree import branches, read_tree

    for i in range(40):
        p = tmp_path / f"d{i % 3}" / f"e{i % 7}" / (".hidden" if i == 5 else "f") / f"m{i}.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"x = {i}\n")
    (tmp_path / "top.go").write_text("package a\n")
    for least in (1, 2, 10, 500):
        rows = read_tree(spark, str(tmp_path), least).collect()
        assert sorted(r["path"] for r in rows) == [r for _, r in walk(str(tmp_path))]
    assert len(branches(str(tmp_path), 1)) == 1 and len(branches(str(tmp_path), 10)) >= 10


def test_words_of_one_concept_are_near():
    from codeweave.functions.encode import encode

    def near(query, *others):
        vectors = encode([query, *others])
        return others[int((vectors[1:] @ vectors[0]).argmax())]

    assert near("sign in", "authenticate_member def authenticate_member(name)", "draw_circle def draw_circle(radius)") == "authenticate_member def authenticate_member(name)"
    assert near("delete a record", "sortKeys(rows)", "removeEntry(row)", "countWords(text)") == "removeEntry(row)"


@pytest.mark.parametrize("lang", ["java", "typescript", "go", "php", "cpp"])
def test_time_grows_with_the_file(lang):
    """Eight times the symbols take about eight times as long, not 64 times."""
    import time

    from codeweave.plans.shapes import SHAPES

    def seconds(n):
        shape = SHAPES[lang]
        lines = ("\n".join(shape.lines).replace("{pk}", str(k)).replace("{a}", "1").replace("{b}", "2") for k in range(n))
        source = "\n".join([*shape.top, *lines, ""]).encode()
        start = time.process_time()
        row = extract_source(f"a{shape.suffix}", source)
        assert len(row["symbols"]) == 2 * n
        return time.process_time() - start

    assert seconds(16000) < 24 * max(seconds(2000), 0.02)


def test_long_python_is_parsed_in_runs(monkeypatch):
    """Runs end between statements, never within strings, brackets, decorators or continued lines; the result is that of the whole."""
    import ast

    from codeweave.sources import extract

    odd = '''x = """
class NotOne:
"""
y = (
1,
)
@wraps(f)
@other
async def go(a: T) -> R:
    # of inner
    def inner(): return call(a)
    return inner
if y:
    class Held(Base): pass
elif x: z = \\
None
# of last
class Last(Base, Base2):
    ünï: T = made(1)
'''
    for source in (odd * 40, odd * 3 + "class Open(:\n" + odd, "# coding: latin-1\n" + odd * 40, odd + "s = '''\nclass A: pass\n" * 2 + "def f(): '''\n" + odd * 9):
        for data in {source.encode(), source.replace("\n", "\r\n").encode(), b"\xef\xbb\xbf" + source.encode()}:
            monkeypatch.setattr(extract, "PART", 1 << 40)
            whole, sizes = extract_source("a/b.py", data), []
            monkeypatch.setattr(extract, "PART", 64)
            with monkeypatch.context() as m:
                m.setattr(extract.ast, "parse", lambda s, parse=ast.parse: sizes.append(len(s)) or parse(s))
                parts = extract_source("a/b.py", data)
            for column, value in whole.items():
                key = lambda v: sorted(v, key=str) if isinstance(v, list) else v
                assert key(parts[column]) == key(value)
            if source == odd * 40 and data.startswith(b"x"):
                assert max(sizes) < len(data) / 10


def test_facts_name_each_id_and_come_in_batches(spark, monkeypatch):
    """Also of a file whose facts are several batches, and beside unknown, missing and empty ones."""
    from codeweave.sources import extract

    monkeypatch.setattr(extract, "ROWS", 7)
    long = "".join(f"class C{i} extends B {{\n  m{i}(x: T) {{ return n(x); }}\n}}\n" for i in range(20))
    files = [("a.ts", long.encode()), ("b.txt", b"x"), ("c.ts", None), ("d.go", b"")]
    rows = [tuple(r) for r in extract.extract_facts(spark.createDataFrame(files, "path string, content binary")).collect()]
    want = []
    for i in range(20):
        at = 3 * i + 1
        want += [("symbol", f"C{i}", "class", at, at + 2), ("symbol", f"m{i}", "method", at + 1, at + 1), ("contains", f"C{i}", f"m{i}", None, None)]
        want += [("base", "B", f"C{i}", None, None), ("call", "n", f"m{i}", at + 1, at + 1), ("use", "T", f"C{i}", None, None)]
    assert sorted(rows, key=str) == sorted((("a.ts", *w) for w in want), key=str)


@pytest.mark.parametrize("lang", ["java", "typescript", "php", "cpp", "go"])
def test_extract_queries_look_up_no_names_in_arrays_and_use_all_tasks(spark, lang):
    """A look-up in a map of a file's symbols reads the map: quadratic in a file. A task for each path is not left to the size of the sources."""
    from codeweave.plans.queries import QUERIES

    df = QUERIES[f"extract_{lang}"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(path" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]

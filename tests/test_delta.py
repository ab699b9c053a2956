"""After an edit, the graph equals one that is built anew, and only what the edit touches is resolved."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.operators import delta, resolve
from codeweave.plans.build import build_index, open_graph

KINDS = ["class", "function", "method", "interface"]


def tree(rng, files):
    """Symbols, references and imports of some files; names are few, so many are ambiguous."""
    symbols, refs, imports = [], [], []
    for path in files:
        at = 0
        for _ in range(rng.randrange(5)):
            at += rng.randrange(1, 20)
            sid = f"{path}#{at}"
            symbols.append((sid, f"n{rng.randrange(9)}", rng.choice(KINDS), path, at))
            refs += [(path, sid, f"n{rng.randrange(11)}", rng.randrange(50)) for _ in range(rng.randrange(4))]
        imports += [(path, o) for o in rng.sample(files, min(2, len(files))) if o != path]
    return symbols, refs, imports


def frames(spark, symbols, refs, imports):
    return (
        spark.createDataFrame(symbols, "id string, name string, kind string, path string, start_byte long"),
        spark.createDataFrame(refs, "path string, src string, name string, line long"),
        spark.createDataFrame(sorted(set(imports)), "src_path string, dst_path string"),
    )


def all_edges(symbols, refs, imports):
    return {
        "CALLS": resolve.resolve_calls(refs.select("src", "name", "line"), symbols, imports),
        "INHERITS": resolve.resolve_inherits(refs.select("src", "name"), symbols),
        "USES": resolve.resolve_uses(refs.select("src", "name"), symbols),
    }


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_edges_after_an_edit_equal_a_full_resolution(spark, seed):
    rng = random.Random(seed)
    files = [f"d/f{i}.py" for i in range(9)]
    first = tree(rng, files)
    edited = set(rng.sample(files, rng.randrange(1, 4)))
    remains = [f for f in files if f not in edited or rng.random() < 0.7]
    there = [f for f in remains if f in edited] + (["d/new.py"] if rng.random() < 0.5 else [])
    fresh = tree(rng, there)
    stay = lambda rows, path: [r for r in rows if r[path] not in edited]
    second = (stay(first[0], 3) + fresh[0], stay(first[1], 0) + fresh[1], [i for i in stay(first[2], 0) if i[1] in remains and rng.random() < 0.9] + fresh[2])
    old_symbols, _, old_imports = old = frames(spark, *first)
    symbols, refs, imports = new = frames(spark, *second)
    changed = spark.createDataFrame([(p,) for p in edited | {"d/new.py"}], "path string")
    names = delta.names_of(old_symbols, changed).unionByName(delta.names_of(symbols, changed)).distinct()
    paths = changed.unionByName(delta.import_changes(old_imports, imports)).distinct()
    before, want = all_edges(*old), all_edges(*new)
    for kind, edges in want.items():
        got = delta.edges_after(kind, before[kind], old_symbols, refs, symbols, names, paths, imports)
        assert sorted(map(str, got.collect())) == sorted(map(str, edges.select(*got.columns).collect())), kind


def stored(spark, root, home):
    g = open_graph(spark, root, home).g
    tables = {n: getattr(g, n) for n in ("files", "symbols", "calls", "uses", "inherits", "contains", "imports", "embeddings", "name_grams", "doc_grams")}
    tables["symbols"] = tables["symbols"].selectExpr("* EXCEPT (rank)", "round(rank, 9) AS rank")
    return {n: sorted(map(str, t.collect())) for n, t in tables.items()}


def test_stored_graph_after_edits_equals_a_new_one(spark, sample_repo, tmp_path, monkeypatch):
    root, home = str(sample_repo), str(tmp_path / "home")
    for i in range(12):
        (sample_repo / f"far{i}.py").write_text(f"def far{i}():\n    return near{i}()\n\n\ndef near{i}():\n    return far{i}()\n")
    build_index(spark, root, home)
    resolved = []
    calls = resolve.resolve_calls

    def counted(sites, *rest):
        resolved.append(sites.count())
        return calls(sites, *rest)

    monkeypatch.setattr(resolve, "resolve_calls", counted)
    edits = [
        lambda: (sample_repo / "far3.py").write_text("# moved\n\ndef far3():\n    return near4()\n"),  # a name goes, and a call turns to another file
        lambda: (sample_repo / "second.py").write_text("def near5():\n    return 1\n\n\ndef board():\n    return far1()\n"),  # names become ambiguous
        lambda: ((sample_repo / "second.py").unlink(), (sample_repo / "far7.py").unlink()),
    ]
    for number, edit in enumerate(edits):
        edit()
        resolved.clear()
        build_index(spark, root, home)
        touched = resolved[0]
        other = str(tmp_path / f"other{number}")
        build_index(spark, root, other)
        assert stored(spark, root, home) == stored(spark, root, other)
        assert touched < resolved[1] / 3


def test_a_file_saved_while_it_is_indexed(spark, sample_repo, tmp_path, monkeypatch):
    """What the graph holds and what the manifest says are of one reading; the next build has nothing left to do."""
    from codeweave.plans import build

    root, home = str(sample_repo), str(tmp_path / "home")
    missing = build.incremental.cache_misses

    def and_saved(*args):
        (sample_repo / "late.py").write_text("def after():\n    return 1\n")
        return missing(*args)

    (sample_repo / "late.py").write_text("def before():\n    return 1\n")
    monkeypatch.setattr(build.incremental, "cache_misses", and_saved)
    first = build_index(spark, root, home, embeddings=False)
    assert not open_graph(spark, root, home).get_symbol("after").isEmpty()
    monkeypatch.setattr(build.incremental, "cache_misses", missing)
    monkeypatch.setattr(build, "tables_of", None)  # a build would fail
    assert build_index(spark, root, home, embeddings=False) == first

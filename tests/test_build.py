import json

import pytest

from codeweave.plans.build import build_index, open_graph
from codeweave.sources.catalog import Catalog, slug


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts(built):
    assert {r["label"]: r["n"] for r in built[2].stats().collect()} == {
        "File": 4, "Symbol": 14, "DEFINED_IN": 14, "CONTAINS": 3, "INHERITS": 1, "IMPORTS": 2, "CALLS": 6, "USES": 2,
    }


LINKS = [  # calls, uses and bases of the sample, by name
    ("Depart", "board"), ("board", "board"), ("deposit", "open_book"), ("deposit", "round_cents"), ("open_book", "new_page"), ("sell", "price"),
    ("Counter", "Fare"), ("Counter", "Savings"), ("Savings", "Account"),
]


def test_ranks_are_those_of_the_power_method(built):
    symbols = [(r["path"], r["name"], r["rank"]) for r in built[2].g.symbols.collect()]
    out = {n: [b for a, b in LINKS if a == n] for _, n, _ in symbols}
    place = {n: [i for i, s in enumerate(symbols) if s[1] == n][0] for _, n, _ in symbols}
    rank = [1 / 14] * 14
    for _ in range(20):
        loose = sum(r for r, (_, n, _) in zip(rank, symbols) if not out[n])
        new = [0.15 / 14 + 0.85 * loose / 14] * 14
        for r, (_, n, _) in zip(rank, symbols):
            for b in out[n]:
                new[place[b]] += 0.85 * r / len(out[n])
        rank = new
    assert [s[2] for s in symbols] == pytest.approx(rank, abs=1e-9)


def test_edges(built):
    g = built[2]
    assert set(rows(g.g.imports)) == {("ledger.py", "storage.py"), ("ticket.ts", "ledger.py")}
    assert set(rows(g.callees("deposit"))) == {
        ("open_book", "storage.py:10", "EXTRACTED", 20), ("round_cents", "ledger.py:12", "EXTRACTED", 21),
    }
    assert set(rows(g.callers("board"))) == {("Depart", "ferry.go:4", "EXTRACTED", 5), ("board", "ferry.go:8", "EXTRACTED", 12)}
    assert {r["name"] for r in g.callees("deposit", depth=2).collect()} == {"open_book", "round_cents", "new_page"}
    assert {r["name"] for r in g.callers("board", depth=3).collect()} == {"Depart", "board"}
    assert [r["name"] for r in g.path("deposit", "new_page").collect()] == ["deposit", "open_book", "new_page"]
    assert [r["name"] for r in g.path("board", "board").collect()] == ["board", "board"]
    assert g.path("new_page", "deposit").isEmpty() and g.path("nobody", "deposit").isEmpty()
    assert rows(g.inheritors("Account")) == [("Savings", "class", "ledger.py:16")]
    assert rows(g.uses("Counter")) == [("Fare", "interface", "ticket.ts:3", "EXTRACTED"), ("Savings", "class", "ledger.py:16", "EXTRACTED")]
    assert rows(g.used_by("Savings", compact=True)) == [("Counter\tclass\tticket.ts:7\tEXTRACTED",)]
    assert rows(g.dependents("storage.py")) == [("ledger.py",)]


def test_bodies(built):
    g = built[2]
    (body,) = rows(g.read_symbol_body("new_page"))
    assert body == ("storage.py:4-5", "function", "def new_page(width):\n    return [None] * width")
    batch = g.batch_read_symbol_bodies(["price", "nobody", "open_book"]).collect()
    assert [(r["ref"], r["error"]) for r in batch] == [("price", None), ("nobody", "not found"), ("open_book", None)]
    assert batch[0]["body"].startswith("function price(payer: Savings)") and batch[0]["body"].endswith("}")
    assert g.read_symbol_body("nobody").isEmpty()


def test_lookups(built):
    g = built[2]
    assert [r["name"] for r in g.search_symbols("LABEL").collect()] == ["label", "label"]
    assert rows(g.list_files("led")) == [("ledger.py",)]
    assert [r["name"] for r in g.search_docs("blank").collect()] == ["open_book"]
    assert g.get_symbol("label").first()["location"] == "ledger.py:7-8"
    assert g.get_symbol("ticket.ts#37").first()["name"] == "Fare"
    assert len(g.symbols_in_file("ledger.py").collect()) == 5
    assert all("\t" in r[0] for r in rows(g.search_symbols("o", compact=True)))
    assert g.hot_symbols(edge="NONSENSE").isEmpty() and g.architecture_violations("a", "b", "CONTAINS").isEmpty()
    assert rows(g.hot_symbols(1)) == [("board", "function", "ferry.go:8", 2)]
    assert rows(g.architecture_violations("ticket", "ledger")) == [("ticket.ts", "ledger.py")]
    assert rows(g.architecture_violations("ledger", "storage", "CALLS")) == [("deposit (ledger.py)", "open_book (storage.py)")]


def test_repo_map_budget_and_prefix(built):
    g = built[2]
    whole = g.repo_map().collect()
    assert [r["rank"] for r in whole] == sorted((r["rank"] for r in whole), reverse=True) and len(whole) == 14
    some = g.repo_map(budget_tokens=30).collect()
    assert 0 < len(some) < 14 and sum(len(r["row"]) // 4 for r in some) <= 30
    assert all("storage.py" in r["row"] for r in g.repo_map("storage").collect())


def test_semantic_search(built):
    hits = built[2].search_semantic("open a book", limit=3).collect()
    assert hits[0]["name"] == "open_book" and len(hits) == 3


def test_nothing_to_do_then_a_change_then_a_deletion(spark, sample_repo, tmp_path):
    home = str(tmp_path / "home")
    first = build_index(spark, str(sample_repo), home, embeddings=False)
    before = Catalog(spark, home).current(str(sample_repo))["version"]
    assert build_index(spark, str(sample_repo), home) == first
    assert Catalog(spark, home).current(str(sample_repo))["version"] == before
    (sample_repo / "storage.py").write_text((sample_repo / "storage.py").read_text() + "\n\ndef shut(book):\n    book.clear()\n")
    (sample_repo / "ferry.go").unlink()
    after = build_index(spark, str(sample_repo), home, embeddings=False)
    assert after["Symbol"] == 14 + 1 - 2 and after["File"] == 3
    assert open_graph(spark, str(sample_repo), home).get_symbol("Depart").isEmpty()


def test_relative_import(spark, tmp_path):
    from codeweave.plans.build import graph_of
    from codeweave.sources.extract import extract_files

    files = [("isle/tide.py", b"HIGH = 4\n"), ("isle/pier.py", b"from .tide import HIGH\n\n\ndef mooring():\n    return HIGH + 1\n")]
    g = graph_of(extract_files(spark.createDataFrame(files, "path string, content binary")))
    assert rows(g.imports) == [("isle/pier.py", "isle/tide.py")]


def test_projects_are_apart(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert slug("/a/repo") != slug("/b/repo") and slug("/").startswith("repo-")
    c.register("/b/repo", {"File": 1})
    c.register("/a/repo", {"File": 2})
    assert [p["root"] for p in c.projects()] == ["/a/repo", "/b/repo"]
    c.register("/a/repo", {"File": 3})
    assert [p["stats"]["File"] for p in c.projects()] == [3, 1]
    c.store.point(f"{tmp_path}/registry/{slug('/a/repo')}", "{broken")
    assert [p["stats"]["File"] for p in c.projects()] == [3, 1]  # the entry before counts


def test_another_schema_version_is_no_graph(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.store.point(c.folder("/x"), json.dumps({"version": "v-1", "schema": -1, "stats": {}}))
    assert c.current("/x") is None and c.graph("/x") is None


def test_publishing_keeps_a_graph_whatever_happens(spark, tmp_path):
    """Pointers are never written over; the version before stays for its readers, what is being written is left alone."""
    c, root = Catalog(spark, str(tmp_path)), "/x"

    def version(n):
        path = c.new_version(root)
        spark.range(n).write.parquet(f"{path}/symbols")
        return path

    first, second, third = version(1), version(2), version(3)
    c.publish(root, first, {"Symbol": 1})
    opened = spark.read.parquet(f"{first}/symbols")
    c.publish(root, second, {"Symbol": 2})
    assert c.current(root)["stats"] == {"Symbol": 2} and opened.count() == 1
    unfinished = c.new_version(root)
    spark.range(1).write.parquet(f"{unfinished}/files")
    c.publish(root, third, {"Symbol": 3})
    left = [n for n in c.store.names(c.folder(root)) if n.startswith("v-")]
    assert sorted(left) == sorted(p.rsplit("/", 1)[-1] for p in (second, third, unfinished))
    assert not c.store.create(f"{c.folder(root)}/CURRENT.{3:012d}", "{}") and c.current(root)["stats"] == {"Symbol": 3}
    c.store.create(f"{c.folder(root)}/CURRENT.{9:012d}", "{half a")  # a crash in a store without atomic moves
    assert c.current(root)["stats"] == {"Symbol": 3}


def test_command_line(spark, built, capsys, monkeypatch):
    from codeweave import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    root, home, _ = built
    assert cli.main(["--home", home, "--root", root, "stats"]) == 0
    assert json.loads(capsys.readouterr().out)["CALLS"] == 6
    assert cli.main(["--home", home, "--root", root, "query", "MATCH (s:Symbol) RETURN count(s) AS n"]) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 14}
    assert cli.main(["--home", home, "--root", root, "sql", "select count(*) AS n from calls"]) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 6}
    assert cli.main(["--home", home, "--root", root, "map", "--budget", "40"]) == 0
    assert capsys.readouterr().out.strip()
    assert cli.main(["--home", home, "--root", "/nowhere", "stats"]) == 1
    assert cli.main(["audit"]) == 0
    assert len(json.loads(capsys.readouterr().out.splitlines()[-1])["tools"]) == 23


def test_one_of_many_writers_gets_a_pointer(spark, tmp_path):
    """Files are put only where there is none, whole, whoever writes at once; pointers of all writers have numbers of their own."""
    from concurrent.futures import ThreadPoolExecutor

    from codeweave.sources.catalog import Store

    store = Store(spark)
    with ThreadPoolExecutor(8) as pool:
        for i in range(10):
            won = list(pool.map(lambda k, i=i: store.create(f"{tmp_path}/c/{i}", str(k) * 1000), range(8)))
            assert won.count(True) == 1 and store.read(f"{tmp_path}/c/{i}") == str(won.index(True)) * 1000
        list(pool.map(lambda k: store.point(f"{tmp_path}/p", json.dumps({"k": k})), range(20)))
    assert sorted(p["k"] for p in store.pointed(f"{tmp_path}/p")) == list(range(20))
    assert sorted(store.names(f"{tmp_path}/c")) == sorted(map(str, range(10)))

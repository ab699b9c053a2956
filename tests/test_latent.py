"""Learned vectors: against a plain SVD, on names held out from the standard library, and in a stored graph."""

import ast
import random
import sysconfig
from pathlib import Path

import numpy as np
import pytest

from codeweave.functions.encode import encode
from codeweave.operators import latent

TEXTS = ["openFile path", "open a file by path", "read_file path mode", "close the file", "sortRows key", "sort rows by a key", "order rows key reverse", "", None, "HTTPServer élan 漢字 x1", "http server"]


def test_words(spark):
    rows = spark.createDataFrame([(t,) for t in ("HTTPServer parse_URLs x1Y", "élan 漢字Ab", None, "--")], "t string")
    got = [r[0] for r in rows.select(latent.words_of(rows["t"])).collect()]
    assert got == [["http", "server", "parse", "ur", "ls", "x", "1", "y", "serv*", "pars*"], ["é", "lan", "漢字", "ab"], [], []]


def test_vectors_equal_those_of_a_plain_svd(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    seen = latent.counted(df, "id", "text")
    entries, shares = latent.matrix(seen, "id", least=1)
    tokens = sorted(r["token"] for r in shares.collect())
    a = np.zeros((len(TEXTS), len(tokens)))
    for r in entries.collect():
        a[r["id"], tokens.index(r["token"])] = r["x"]
    for rank in (3, 6):
        model = latent.fit(df, "id", "text", rank=rank, more=12, rounds=6, least=1, damp=0.5)
        _, s, vt = np.linalg.svd(a, full_matrices=False)
        plain = a @ vt[:rank].T * s[:rank] ** -0.5
        vectors = {r["token"]: r["vector"] for r in model.collect()}
        got = a @ np.array([vectors[t] for t in tokens])
        assert np.abs(got @ got.T - plain @ plain.T).max() < 1e-6  # the same but for signs
        rows = {r["id"]: np.array(r["embedding"]) for r in latent.encode(df, model, "id", "text", rank).collect()}
        unit = plain / np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-12)
        whole = np.array([rows[i] for i in range(len(TEXTS))])
        assert np.abs(whole @ whole.T - unit @ unit.T).max() < 1e-5 and not whole[[7, 8]].any()
        assert np.abs(np.array(latent.encode_query(model, TEXTS[1], rank)) - rows[1]).max() < 1e-6


def test_no_texts_and_no_shared_words(spark):
    nothing = spark.createDataFrame([], "id long, text string")
    assert latent.fit(nothing, "id", "text").isEmpty() and latent.encode(nothing, latent.fit(nothing, "id", "text"), "id", "text").isEmpty()
    apart = spark.createDataFrame([(1, "one"), (2, "two")], "id long, text string")
    model = latent.fit(apart, "id", "text")
    assert model.isEmpty() and [set(r["embedding"]) for r in latent.encode(apart, model, "id", "text").collect()] == [{0.0}, {0.0}]
    assert set(latent.encode_query(model, "one")) == {0.0}


@pytest.fixture(scope="module")
def library():
    """(name, parameters, first paragraph of the comment) of the functions and classes of Python's own library."""
    out, root = [], Path(sysconfig.get_paths()["stdlib"])
    for p in sorted([*root.glob("*.py"), *root.glob("*/*.py")]):
        if {"site-packages", "test", "idlelib"} & set(p.parts):
            continue
        try:
            tree = ast.parse(p.read_text())
        except (SyntaxError, UnicodeDecodeError):
            continue
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not n.name.startswith("__"):
                out.append((n.name, " ".join(a.arg for a in n.args.args) if isinstance(n, ast.FunctionDef) else "", (ast.get_docstring(n) or "").split("\n\n")[0]))
    return out


def test_comments_find_names_they_were_never_seen_with(spark, library):
    """A tenth of the comments is held out; each asks for its function among the held-out names, which is to be in the first ten."""
    rng = random.Random(1)
    held = [i for i, (_, _, doc) in enumerate(library) if len(doc.split()) >= 5 and rng.random() < 0.1]
    hidden = set(held)
    seen = spark.createDataFrame([(i, f"{n} {a} {'' if i in hidden else d}") for i, (n, a, d) in enumerate(library)], "id long, text string").repartition(4)
    model = latent.fit(seen, "id", "text")
    names, asked = [f"{library[i][0]} {library[i][1]}" for i in held], [library[i][2] for i in held]

    def learned(texts):
        rows = {r["id"]: r["embedding"] for r in latent.encode(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model, "id", "text").collect()}
        return np.array([rows[i] for i in range(len(texts))])

    def recall(n, q):
        scores = q @ n.T
        own = np.arange(len(held))
        return ((scores > scores[own, own][:, None]).sum(axis=1) < 10).mean()

    by_model, by_hash = recall(learned(names), learned(asked)), recall(encode(names), encode(asked))
    assert by_model > by_hash + 0.05, (by_model, by_hash)


def test_stored_graph_with_learned_vectors(spark, sample_repo, tmp_path):
    from codeweave.plans.build import build_index, open_graph

    home = str(tmp_path / "home")
    build_index(spark, str(sample_repo), home, learned=True)
    g = open_graph(spark, str(sample_repo), home)
    assert not g.g.latent.isEmpty() and {len(r["embedding"]) for r in g.g.embeddings.collect()} == {latent.RANK}
    assert g.search_semantic("round an amount to cents", limit=3).count() == 3
    (sample_repo / "extra.py").write_text("def round_up(amount):\n    return amount\n")
    build_index(spark, str(sample_repo), home)  # stays learned
    g = open_graph(spark, str(sample_repo), home)
    assert not g.g.latent.isEmpty() and "round_up" in {r["name"] for r in g.search_semantic("round amount", limit=3).collect()}
    build_index(spark, str(sample_repo), home, full=True, learned=False)
    assert open_graph(spark, str(sample_repo), home).g.latent.isEmpty()


def test_matrix_query_counts_words_once(spark):
    """The words of the documents are cut and counted once; all that follows reads the written counts."""
    from codeweave.plans.queries import QUERIES

    plan = QUERIES["latent_matrix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan

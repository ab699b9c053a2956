"""Operators against plain Python on small random inputs."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeweave.operators import incremental, rank, resolve, similarity, traverse

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
EDGES = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=16)


def frame(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")


def reach(edges, start, depth):
    at, found = {start}, {}
    for hop in range(1, depth + 1):
        at = {b for a, b in edges if a in at}
        for n in at:
            found.setdefault(n, hop)
    return found


@SLOW
@given(EDGES, st.integers(1, 4))
def test_k_hop(spark, edges, depth):
    got = traverse.k_hop(frame(spark, edges), spark.createDataFrame([("0",)], "id string"), depth)
    assert {int(r["id"]): r["hop"] for r in got.collect()} == reach(edges, 0, depth)


@SLOW
@given(EDGES)
def test_shortest_path(spark, edges):
    got = traverse.shortest_path(frame(spark, edges), spark.createDataFrame([("0",)], "id string"), spark.createDataFrame([("7",)], "id string")).collect()
    best = reach(edges, 0, 6).get(7)
    if best is None:
        assert got == []
    else:
        (row,) = got
        ids = list(map(int, row["ids"]))
        assert row["hops"] == best == len(ids) - 1 and ids[0] == 0 and ids[-1] == 7
        assert all(p in edges for p in zip(ids, ids[1:]))


def test_cycles_and_depth_clamp(spark):
    e = frame(spark, [(1, 2), (2, 1)])
    start = spark.createDataFrame([("1",)], "id string")
    assert {r["id"]: r["hop"] for r in traverse.k_hop(e, start, 99).collect()} == {"2": 1, "1": 2}
    assert traverse.shortest_path(e, start, start).first()["ids"] == ["1", "2", "1"]
    assert traverse.clamp(0) == 1 and traverse.clamp(9) == 6


def plain_rank(nodes, edges, damping=0.85, iterations=20):
    out = defaultdict(list)
    for a, b in edges:
        if a in nodes and b in nodes:
            out[a].append(b)
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(iterations):
        new = dict.fromkeys(nodes, (1 - damping) / len(nodes) + damping * sum(r[n] for n in nodes if not out[n]) / len(nodes))
        for a in out:
            for b in out[a]:
                new[b] += damping * r[a] / len(out[a])
        r = new
    return r


def test_pagerank(spark):
    edges = [(0, 1), (1, 2), (0, 2), (0, 2), (3, 9), (2, 0), (4, 4)]
    nodes = spark.createDataFrame([(str(n),) for n in range(5)], "id string")
    got = {int(r["id"]): r["rank"] for r in rank.pagerank(nodes, frame(spark, edges)).collect()}
    expected = plain_rank(set(range(5)), edges)
    assert all(abs(got[n] - expected[n]) < 1e-12 for n in expected) and abs(sum(got.values()) - 1) < 1e-9
    assert rank.pagerank(nodes.limit(0), frame(spark, edges)).isEmpty()


def test_every_confidence_tier(spark):
    symbols = [("a.py#1", "f", "a.py"), *[(f"m{i}.py#1", "many", f"m{i}.py") for i in range(7)], ("a.py#2", "here", "a.py"), ("b.py#1", "here", "b.py")]
    symbols += [("c.py#1", "twice", "c.py"), ("c.py#9", "twice", "c.py"), ("d.py#1", "twice", "d.py")]
    s = spark.createDataFrame([(i, n, p, "function") for i, n, p in symbols], "id string, name string, path string, kind string")
    imports = spark.createDataFrame([("a.py", "m3.py"), ("a.py", "c.py")], "src_path string, dst_path string")
    sites = [("a.py#1", "f", 1), ("a.py#1", "many", 2), ("a.py#1", "here", 3), ("a.py#1", "twice", 4), ("a.py#1", "nowhere", 5), ("b.py#1", "many", 6), ("a.py#1", "f", 9)]
    got = {(r["src"], r["dst"]): (r["confidence"], r["line"]) for r in resolve.resolve_calls(spark.createDataFrame(sites, "src string, name string, line long"), s, imports).collect()}
    assert got == {
        ("a.py#1", "a.py#1"): ("EXTRACTED", 1),  # recursion stays; the first line counts
        ("a.py#1", "m3.py#1"): ("INFERRED", 2),
        ("a.py#1", "a.py#2"): ("EXTRACTED", 3),
        **{("a.py#1", d): ("AMBIGUOUS", 4) for d in ("c.py#1", "c.py#9", "d.py#1")},  # two in the imported file
        **{("b.py#1", f"m{i}.py#1"): ("AMBIGUOUS", 6) for i in range(5)},  # five at most
    }


SPANS = st.lists(st.tuples(st.integers(0, 9000), st.integers(1, 6000)), min_size=1, max_size=12, unique_by=lambda s: s[0])


@SLOW
@given(SPANS)
def test_enclosing(spark, spans):
    rows = [(f"x#{a}", "x", a, a + n, "class" if i % 2 else "function") for i, (a, n) in enumerate(spans)]
    symbols = spark.createDataFrame(rows, "id string, path string, start_byte long, end_byte long, kind string")
    got = {r["dst"]: r["src"] for r in resolve.contains(symbols).collect()}
    expected = {}
    for i, _, a, _, _ in rows:
        around = [(e - s, j) for j, _, s, e, _ in rows if s <= a < e and j != i]
        if around:
            expected[i] = min(around)[1]
    assert got == expected


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("b", "9"), ("c", "3"), ("d", "4")], "path string, hash string")
    assert {tuple(r) for r in incremental.manifest_diff(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("c", "same"), ("d", "added")}
    assert {tuple(r) for r in incremental.upsert(old, new, "path").collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}
    assert incremental.unchanged(old, old) and not incremental.unchanged(old, new)


def test_nearest(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0]), ("odd", [1.0])], "id string, embedding array<float>")
    assert [(r["id"], round(r["score"], 4)) for r in similarity.nearest(v, [2.0, 0.0], 9).collect()] == [("a", 1.0), ("b", 0.6), ("z", 0.0)]
    assert similarity.nearest(v.limit(0), [1.0], 3).isEmpty()
    assert round(sum(x * x for x in similarity.normalised(v).where("id = 'b'").first()["embedding"]), 5) == 1


def test_bodies_are_bytes_and_survive_bad_utf8(spark):
    from pyspark.sql import functions as F

    from codeweave.functions.text import body_of, language_of, location, normalised_path, slug_of

    df = spark.createDataFrame([(b"\xc3\xa9def\xff end",)], "c binary")
    assert df.select(body_of(F.col("c"), F.lit(2), F.lit(6))).first()[0] == "def�"
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/b.PY",), ("Makefile",), (".py",)], "p string")
    assert [r[0] for r in paths.select(normalised_path(F.col("p"))).collect()] == ["a/c", "../x", "a/b.PY", "Makefile", ".py"]
    assert [r[0] for r in paths.select(language_of(F.col("p"))).collect()] == [None, None, "python", None, None]
    assert paths.select(location(F.col("p"), F.lit(3), F.lit(5))).first()[0] == "a/./b/../c:3-5"
    assert paths.select(slug_of(F.lit("/x/my repo"))).first()[0].startswith("my-repo-")


@settings(max_examples=12, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=30), st.sets(st.integers(0, 11), min_size=1, max_size=3), st.sets(st.integers(0, 11), min_size=1, max_size=3), st.integers(1, 6))
def test_frontiers_from_both_ends_find_the_path_of_a_search_from_one(spark, edges, start, end, depth):
    """Level by level from the start: each node's smallest predecessor, the smallest end node of the first level that has one."""
    level, parents, seen, hit = {f"n{i:02}" for i in start}, [], set(), None
    links, ends = [(f"n{a:02}", f"n{b:02}") for a, b in edges], {f"n{i:02}" for i in end}
    for _ in range(depth):
        reached = {}
        for a, b in sorted(links, reverse=True):
            if a in level and b not in seen:
                reached[b] = a
        parents.append(reached)
        if set(reached) & ends:
            hit = min(set(reached) & ends)
            break
        seen |= set(reached)
        level = set(reached)
    want = []
    if hit:
        ids = [hit]
        for p in reversed(parents):
            ids.append(p[ids[-1]])
        want = [(ids[::-1], len(ids) - 1)]
    frame = lambda xs: spark.createDataFrame([(f"n{i:02}",) for i in xs], "id string")
    got = traverse.shortest_path(spark.createDataFrame(links, "src string, dst string"), frame(start), frame(end), depth).collect()
    assert [(r["ids"], r["hops"]) for r in got] == want

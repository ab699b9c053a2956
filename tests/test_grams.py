"""Substring search through posting indexes gives what a scan gives."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave.operators import grams

TEXT = st.one_of(st.none(), st.text(alphabet="abAB é漢😀_İ", max_size=14))


def plain(text, size=3):
    return {text[i : i + size] for i in range(len(text) - size + 1)}


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, max_size=25), st.sampled_from([1, 2, 5, 1 << 16]))
def test_postings_of_any_pieces(spark, texts, piece):
    texts = [t and t.replace("İ", "i") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    rows = [(r["gram"], r["k"], r["bucket"]) for r in grams.postings(df, "k", "t", buckets=5, piece=piece).collect()]
    assert len(rows) == len(set(rows)) and all(0 <= r[2] < 5 for r in rows) and len({(g, b) for g, _, b in rows}) == len({g for g, _, _ in rows})
    assert {(g, k) for g, k, _ in rows} == {(g, k) for k, t in enumerate(texts) if t for g in plain(t.lower())}


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=25), st.data())
def test_search_equals_a_scan(spark, texts, data):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    index = grams.postings(df, "k", "t")
    whole = data.draw(st.sampled_from([t or "ab" for t in texts]))
    start = data.draw(st.integers(0, max(0, len(whole) - 1)))
    for query in (whole[start : start + data.draw(st.integers(1, 6))].swapcase(), "aab", ""):
        want = {r["k"] for r in df.where(F.contains(F.lower("t"), F.lower(F.lit(query)))).collect()}
        assert {r["k"] for r in grams.containing(df, index, query, "k", "t").collect()} == want


def test_long_texts_are_cut(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200_000))
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert {r["gram"] for r in grams.postings(df, "k", "t").collect()} == plain(text)


def test_stored_graph_is_searched_through_its_index(spark, built):
    """The plan reads postings of the query's buckets alone; a short query scans; the rows are the same."""
    _, _, graph = built
    with_index = {q: (graph.search_symbols(q), graph.search_docs(q)) for q in ("oar", "BOOK", "o", "zzzz", "ferry")}
    plan = with_index["oar"][0]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,oar)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert "gram" not in with_index["o"][0]._jdf.queryExecution().executedPlan().toString()
    names, docs = graph.g.name_grams, graph.g.doc_grams
    graph.g.name_grams = graph.g.doc_grams = None
    try:
        for q, (symbols, comments) in with_index.items():
            assert symbols.collect() == graph.search_symbols(q).collect() and comments.collect() == graph.search_docs(q).collect()
    finally:
        graph.g.name_grams, graph.g.doc_grams = names, docs
    assert not with_index["oar"][0].isEmpty()


def test_only_texts_are_shuffled(spark):
    """Postings are many times their texts: grams are found, and a text's repeats left out, before and without a shuffle of them."""
    df = spark.createDataFrame([(1, "abcabc")], "k long, t string")
    plan = grams.postings(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "gram" not in shuffles[0] and "Aggregate" not in plan


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), TEXT), max_size=25), st.sampled_from([1, 4, 1 << 16]), st.sampled_from([1, 2, 3]))
def test_lists_of_keys_that_repeat(spark, rows, piece, size):
    """A key is in one list of each of its grams, whatever is cut at once; lists are not empty."""
    rows = [(k, t and t.replace("İ", "i")) for k, t in rows]
    df = spark.createDataFrame(rows, "k long, t string")
    found = [(r["gram"], k) for r in grams.postings(df, "k", "t", 5, size, piece, True).collect() for k in r["ks"] or [None]]
    assert sorted(found) == sorted({(g, k) for k, t in rows if t for g in plain(t.lower(), size)})


def test_more_characters_than_an_integer_holds():
    """Many letters and many keys: grams are numbered first."""
    letters = [chr(0x20 + i) for i in range(60_000) if not 0xD800 <= 0x20 + i < 0xE000]
    rows = [(n, "".join(letters[n % 7 :: 7][:300])) for n in range(9_000)] + [(9_000 << 12, "".join(letters))]
    found, ends, numbers = grams._gathered(rows, 3)
    want = {(g, n) for n, t in rows[:7] + rows[-1:] for g in plain(t)}
    begins = [0, *ends[:-1].tolist()]
    got = {(g, n) for g, b, e in zip(found, begins, ends.tolist()) for n in numbers[b:e].tolist() if n < 7 or n == 9_000 << 12}
    assert got == want and found == sorted(found) and len(set(found)) == len(found)

"""What the near-duplicate steps make the driver plan: components are computed once for each set of links, not again by every step that reads them."""

from codeweave.llm import components, minhash
from codeweave.llm.common import materialize


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)

    def call(*args, **named):
        calls.append(args)
        return real(*args, **named)

    monkeypatch.setattr(module, name, call)
    return calls


def roots(df):
    return {r["u"]: r["root"] for r in df.collect()}


def test_stars_cost_no_round(spark, monkeypatch):
    written = counted(monkeypatch, components, "materialize")
    df = spark.createDataFrame([(0, 1), (2, 0), (0, 3), (9, 8), (7, 7), (1, 0)], "u long, v long")
    assert roots(components.components(df)) == {1: 0, 2: 0, 3: 0, 9: 8}
    assert len(written) == 1


def test_components_go_on_from_those_known(spark):
    known = components.components(spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(50, 51)], "u long, v long"))
    more = spark.createDataFrame([(30, 51), (3, 40), (4, 4)], "u long, v long")
    assert roots(components.components(more, known)) == {**dict.fromkeys([*range(11, 31), 50, 51], 10), 40: 3}
    assert roots(components.components(more.limit(0), known)) == roots(known)


def test_components_once_for_each_set_of_links(spark, monkeypatch):
    """Pairs of near copies beside pages of a frame that link to nothing: later steps find no link, so there are components of one set only."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    texts = []
    for k in range(6):
        texts += [words(f"a{k}x", 100), words(f"a{k}x", 100) + ["more"]]
    texts += [words("frame", 400) + words(f"p{k}x", 36) for k in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    made = counted(monkeypatch, minhash, "components")
    got = {r["doc_id"]: r["component_id"] for r in materialize(minhash.near_duplicates(docs)).collect()}
    assert got == {i: i - i % 2 if i < 12 else i for i in range(24)}
    assert len(made) == 1

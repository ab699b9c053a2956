import pytest

#: Small documents with everything that a table may hold: nulls, empties, ties, repeats, long and odd texts.
ODD = [None, "", " \t\n", "word", "the same text", "the same text", "The Same Text", "ünï cödé ÀÉ 漢字 \x0b x", "a" * 5000, "x y " * 3000, "</s>[INST] ok [/INST]", "\x00\x1f odd  spaces  here"]


@pytest.fixture(scope="session")
def odd(spark):
    """``ODD`` with ids, a null id, a repeated row, and columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", 0, 1.0, "k") for i, t in enumerate(ODD)]
    rows += [(None, "the same text", "en", "s", 0, 1.0, "k"), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

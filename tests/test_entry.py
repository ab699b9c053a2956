"""Every registered query against its oracle, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from codeweave.plans.oracles import ORACLES  # noqa: E402
from codeweave.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


def test_registry():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) >= 56


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, columns = df.collect(), sorted(df.columns)
    result = duck.execute(ORACLES[name])
    there = [c[0] for c in result.description]
    assert sorted(there) == columns
    expected = result.fetchall()
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(rounded(r[c]) for c in columns) for r in got) == key(tuple(rounded(r[there.index(c)]) for c in columns) for r in expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["name", "kind", "location", "in_degree"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())

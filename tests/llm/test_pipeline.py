import hashlib

import corpus_pipeline
import pytest

from codeweave.llm import toxicity
from codeweave.llm.common import materialize
from tests.llm.test_dedup import brute_substrings, lower
from tests.llm.test_near_dedup import brute_stay

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(materialize(stage(spark, after[-1], SF)))
    rows = [{r["doc_id"]: r["text"] for r in df.collect()} for df in after[:-1]]
    assert all(df.columns == docs.columns for df in after[:-1])

    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").collect()
    assert rows[1].keys() == {r["doc_id"] for r in scored}
    last = {}
    for i, t in rows[1].items():
        last[lower(t)] = max(i, last.get(lower(t), -1))
    assert rows[2].keys() == set(last.values())
    assert rows[3].keys() == brute_stay(rows[2])
    expected = {d: (n, gone, sha) for d, n, gone, sha in brute_substrings(list(rows[3].items()))}
    for d, text in rows[4].items():
        n, gone, sha = expected.pop(d)
        assert hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest() == sha
        assert gone or text == rows[3][d]
    assert all(gone == n for n, gone, _ in expected.values())  # only emptied documents went
    packed = {r["doc_id"]: r["n"] for r in after[-1].groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert packed.keys() == rows[4].keys()
    total = {r["doc_id"]: r["doc_tokens"] for r in after[-1].select("doc_id", "doc_tokens").distinct().collect()}
    assert packed == total


def test_run_is_the_stages_in_order(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_tables(spark, odd, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = odd.selectExpr("*", "'x' AS _own_0", "2L AS node", "'y' AS ranges", "array(1L) AS bands", "3L AS fp", "'z' AS component_id")
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0

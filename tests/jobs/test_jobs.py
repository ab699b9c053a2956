import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import module_report, text_index
from jobs.common import config_of
from jobs.queries import ORACLES, QUERIES
from tests.test_entry import SF, TABLES, rounded

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string"


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))
    return name


def plain(texts):
    return {(t.lower()[i : i + 3], d) for d, t in texts.items() if t for i in range(len(t) - 2)}


def now(spark, out):
    rows = [(r["gram"], r["doc_id"]) for r in text_index.current(spark, out).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def growing(tmp_path):
    return tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_second_run_takes_only_what_is_new(spark, growing):
    """On a copy of the documents that grows: new ones, a changed one, one that comes again as it was."""
    source, out, checkpoint = growing
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()}
    ids = sorted(docs)
    put(spark, [tuple(docs[i]) for i in ids[:120]], source, "first")
    first = text_index.run(spark, str(source), out, checkpoint)
    assert (first["batches"], first["read"], first["indexed"]) == (1, 120, 120)
    assert now(spark, out) == plain({i: docs[i]["text"] for i in ids[:120]})
    assert text_index.run(spark, str(source), out, checkpoint) == {"batches": 0, "read": 0, "without_id": 0, "indexed": 0, "postings": 0}

    changed = {**{i: docs[i]["text"] for i in ids}, ids[3]: "quite another text"}
    put(spark, [tuple(docs[i]) for i in ids[120:]] + [(ids[3], "quite another text", "en", "s"), tuple(docs[ids[4]])], source, "second")
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    second = text_index.run(spark, str(source), out, checkpoint)
    assert second["read"] == len(ids) - 120 + 2 and second["indexed"] == len(ids) - 120 + 1
    assert {p: p.stat().st_mtime_ns for p in before} == before  # what was written stays as it is
    assert now(spark, out) == plain(changed)
    held = {r["doc_id"]: r for r in text_index.manifest(spark, out).collect()}
    assert held.keys() == docs.keys() and held[ids[3]]["batch"] == 1 and held[ids[4]]["batch"] == 0

    found = {r["doc_id"] for r in text_index.search(spark, out, spark.createDataFrame(list(changed.items()), "doc_id long, text string"), "ANOTHER te").collect()}
    assert found == {i for i, t in changed.items() if "another te" in t.lower()} and ids[3] in found


def test_a_batch_that_failed_half_way_is_run_again(spark, growing, monkeypatch):
    """Postings are written, the manifest is not: the next run writes the batch anew, over its own files only."""
    source, out, checkpoint = growing
    put(spark, [(1, "some words here", "en", "s")], source, "first")
    text_index.run(spark, str(source), out, checkpoint)
    put(spark, [(2, "more words there", "en", "s"), (1, "other words", "en", "s")], source, "second")
    written = text_index.grams.postings

    def fails_after(*args):
        written(*args).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings/batch=1")
        raise RuntimeError("executor lost")

    monkeypatch.setattr(text_index.grams, "postings", fails_after)
    with pytest.raises(Exception, match="executor lost"):
        text_index.run(spark, str(source), out, checkpoint)
    assert now(spark, out) == plain({1: "some words here"})  # readers see the state of the last whole batch
    monkeypatch.setattr(text_index.grams, "postings", written)
    assert text_index.run(spark, str(source), out, checkpoint)["indexed"] == 2
    assert now(spark, out) == plain({1: "other words", 2: "more words there"})


def test_odd_documents(spark, growing):
    source, out, checkpoint = growing
    assert_rows = [(1, None, None, None), (2, "", "en", "s"), (3, "ab", "en", "s"), (None, "no id at all", "en", "s"), (4, "aaaa", "en", "s"), (4, "bbbb", "en", "s"), (5, "Ünï 漢字 😀x", "xx", "s"), (6, "xyz " * 40_000, "en", "s")]
    put(spark, assert_rows, source, "all")
    done = text_index.run(spark, str(source), out, checkpoint, {"buckets": 3})
    assert done["without_id"] == 1 and done["indexed"] == 6
    assert now(spark, out) == plain({5: "Ünï 漢字 😀x", 6: "xyz " * 40_000}) | {("aaa", 4), ("bbb", 4)}
    assert {r["doc_id"] for r in text_index.manifest(spark, out).collect()} == {1, 2, 3, 4, 5, 6}


def test_nothing_to_read(spark, growing):
    source, out, checkpoint = growing
    spark.createDataFrame([], DOCS).write.parquet(str(source))
    assert text_index.run(spark, str(source), out, checkpoint)["indexed"] == 0
    assert now(spark, out) == set() and text_index.manifest(spark, out).isEmpty()


def test_search_reads_only_the_buckets_of_a_query(spark, growing):
    source, out, checkpoint = growing
    put(spark, [(i, f"number {i} of the rows", "en", "s") for i in range(50)], source, "all")
    text_index.run(spark, str(source), out, checkpoint)
    plan = text_index.grams.candidates(text_index.current(spark, out), "number", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "In(gram" in plan


def test_snapshots_are_replaced_whole_and_kept_apart(spark, tmp_path):
    out = str(tmp_path / "out")
    first = module_report.run(spark, SF, out, {"as_of": "a"})
    rows = sorted(map(str, module_report.read(spark, out).collect()))
    assert first["edges"] + first["hot"] + first["cycle"] == first["rows"] == len(rows) > 0
    assert module_report.run(spark, SF, out, {"as_of": "a"}) == first
    assert sorted(map(str, module_report.read(spark, out).collect())) == rows
    spark.createDataFrame([("x", "y", "z", 1, 0, None)], "part string, item string, kind string, n long, unsure long, rank int").withColumn("module", F.lit("gone")).write.mode("append").partitionBy("module").parquet(f"{out}/as_of=a")
    module_report.run(spark, SF, out, {"as_of": "a"})  # a module that is no more goes
    module_report.run(spark, SF, out, {"as_of": "b", "top": 1})
    both = module_report.read(spark, out)
    assert sorted(map(str, both.where("as_of = 'a'").collect())) == rows
    assert both.where("as_of = 'b' AND part = 'hot'").agg(F.max("rank")).first()[0] == 1


def test_report_on_empty_tables(spark, tmp_path):
    for t in ("part", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert module_report.run(spark, str(tmp_path), str(tmp_path / "out"))["rows"] == 0
    assert module_report.read(spark, str(tmp_path / "out")).isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = spark.sparkContext._jsc.sc().getConf().toDebugString(), dict(spark.sql("SET").collect())
    df = QUERIES[name](spark, SF)
    assert (spark.sparkContext._jsc.sc().getConf().toDebugString(), dict(spark.sql("SET").collect())) == before
    result = con.execute(ORACLES[name])
    there, columns = [c[0] for c in result.description], sorted(df.columns)
    assert sorted(there) == columns
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[there.index(c)] for c in columns) for r in result.fetchall()), key=str) and got


def test_config(spark, tmp_path):
    for job in (text_index, module_report):
        name = job.__name__.split(".")[1]
        assert config_of(spark, str(ROOT / "jobs" / f"{name}.json"), job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "c.json").write_text('{"tops": 3}')
    with pytest.raises(ValueError, match="tops"):
        config_of(spark, str(tmp_path / "c.json"), module_report.DEFAULTS)


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text('{"as_of": "2024-01", "top": 2}')
    run = subprocess.run([sys.executable, "-m", "jobs.module_report", "--tables", SF, "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert json.loads(run.stdout.strip().splitlines()[-1])["hot"] > 0 and "wrote to" in run.stderr
    assert (tmp_path / "out" / "as_of=2024-01" / "_SUCCESS").exists()

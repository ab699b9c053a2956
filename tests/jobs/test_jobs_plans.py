"""What the jobs read and resolve once, or don't shuffle."""

import pytest
from pyspark.sql import functions as F

from codeweave.operators.resolve import resolve_counted
from codeweave.plans.binding import Binding
from jobs import module_report, text_index

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_report_resolves_the_graph_once(spark, tmp_path, monkeypatch):
    plans = []

    def report(sent, top, make=module_report.report):
        plans.append(plan_of(rows := make(sent, top)))
        return rows

    monkeypatch.setattr(module_report, "report", report)
    module_report.run(spark, SF, str(tmp_path / "out"))
    assert len(plans) == 1 and "part.parquet" not in plans[0] and "lineitem" not in plans[0]
    assert not [p for p in (tmp_path / "out/_work").rglob("*") if p.is_file()]


def test_postings_are_shuffled_only_where_documents_come_again(spark, tmp_path):
    def run(number, rows):
        spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(str(tmp_path / f"new{number}"))
        for f in (tmp_path / f"new{number}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{number}-{f.name}")
        text_index.run(spark, str(tmp_path / "in"), out, f"{out}/checkpoint")
        return text_index.current(spark, out)

    out = str(tmp_path / "out")
    first = run(0, [(1, "en", "abcd"), (2, "en", "wxyz")])
    assert "SortMergeJoin" not in plan_of(first) and "doc_id" not in plan_of(first).split("BroadcastHashJoin")[1].split("\n")[0]
    assert sorted((r["gram"], r["doc_id"]) for r in first.collect()) == [("abc", 1), ("bcd", 1), ("wxy", 2), ("xyz", 2)]
    # postings of a batch that didn't get as far as its manifest don't count
    spark.createDataFrame([("zzz", 9, 0)], "gram string, doc_id long, bucket int").write.partitionBy("bucket").parquet(f"{out}/postings/batch=7")
    second = run(1, [(1, "en", "abce")])
    assert sorted((r["gram"], r["doc_id"]) for r in second.collect()) == [("abc", 1), ("bce", 1), ("wxy", 2), ("xyz", 2)]


def test_batches_of_one_row_a_document_are_still_read(spark, tmp_path):
    """Postings as they were written before lists were kept, beside a batch of lists."""
    out = str(tmp_path / "out")
    spark.createDataFrame([(7, "abcd", "en")], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "in"))
    text_index.run(spark, str(tmp_path / "in"), out, f"{out}/checkpoint")
    spark.createDataFrame([("xyz", 9, 0), ("abc", 9, 1)], "gram string, doc_id long, bucket int").write.partitionBy("bucket").parquet(f"{out}/postings/batch=5")
    spark.createDataFrame([(9, "en", "h")], "doc_id long, lang string, hash string").write.parquet(f"{out}/manifest/batch=5")
    assert sorted((r["gram"], r["doc_id"]) for r in text_index.current(spark, out).collect()) == [("abc", 7), ("abc", 9), ("bcd", 7), ("xyz", 9)]


def test_calls_are_counted_from_one_shuffle_of_the_lines(spark):
    """Without the rows of callsites, which are as many as lines and wide."""
    bound = Binding(spark, SF)
    assert plan_of(bound.called).count("lineitem.parquet") == 1
    given = spark.createDataFrame([], "src_path string, name string, calls long")
    assert "lineitem" not in plan_of(module_report.links(bound, given))


def odd_tables(spark, folder):
    """Lines that repeat, miss a number, lack a key or name no part; parts of one name in a file and in others, and one that comes twice."""
    parts = [(k, f"part {k % 3}", "A" if k < 20 else "B", f"Brand#{k % 5}", 1) for k in range(40)] + [(10, "part 1", "A", "Brand#0", 1)]
    schema = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(f"{folder}/part.parquet")
    lines = [(o, n, (o * 5 + n * n) % 42) for o in range(40) for n in range(1, 6) if (o + n) % 7]
    lines += [(o, n, p + 1) for o, n, p in lines[::3]] + [(None, 1, 1), (None, 2, 2), (50, None, 3), (50, 1, None), (50, 2, 4), (50, 3, 4), (51, 1, 4), (51, 2, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("odd", [False, True])
def test_counted_calls_are_the_calls_added_up(spark, tmp_path, odd):
    bound = Binding(spark, odd_tables(spark, str(tmp_path)) if odd else SF)
    counted = resolve_counted(bound.called, bound.by_id, bound.imports).groupBy("src_path", "dst", "confidence").agg(F.sum("calls").alias("n"))
    paths = bound.symbols.select(F.col("id").alias("src"), F.col("path").alias("src_path")).distinct()
    one_by_one = bound.calls.join(paths, "src").groupBy("src_path", "dst", "confidence").agg(F.count("*").alias("n"))
    rows = sorted(map(tuple, counted.collect()))
    assert rows == sorted(map(tuple, one_by_one.collect())) and {r[2] for r in rows} >= {"AMBIGUOUS", "EXTRACTED"}

"""The jobs as queries: each runs twice into one new folder, and gives the whole output as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeweave.plans.oracles import with_edges
from codeweave.plans.scratch import scratch_dir
from jobs import module_report, text_index


def job1_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark)
    for _ in range(2):
        text_index.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return text_index.current(spark, out).select("gram", "doc_id")


def job2_module_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark)
    for _ in range(2):
        module_report.run(spark, sf_dir, out)
    return module_report.read(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_text_index": job1_text_index, "job2_module_report": job2_module_report}

ORACLES: dict[str, str] = {
    "job1_text_index": """
        WITH d AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents WHERE length(text) >= 3)
        SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM d
    """,
    "job2_module_report": with_edges(
        """, m AS (SELECT id, split_part(path, '/', 1) AS module FROM sym),
        e AS (SELECT src, dst, 'CALLS' AS kind, confidence FROM calls UNION ALL SELECT src, dst, 'USES', confidence FROM use UNION ALL SELECT src, dst, 'INHERITS', confidence FROM inh),
        x AS (SELECT a.module, b.module AS other, e.dst, e.kind, CAST(e.confidence = 'AMBIGUOUS' AS INT) AS u FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst),
        y AS (SELECT other AS module, dst AS item, count(*) AS n, sum(u) AS unsure FROM x WHERE module <> other GROUP BY other, dst),
        h AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, item) AS rank FROM y),
        p AS (SELECT module, other, count(*) AS n, sum(u) AS unsure FROM x WHERE module <> other GROUP BY module, other)
        SELECT part, item, kind, n, CAST(unsure AS BIGINT) AS unsure, CAST(rank AS INTEGER) AS rank, 'latest' AS as_of, module FROM (
            SELECT 'edges' AS part, other AS item, kind, count(*) AS n, sum(u) AS unsure, NULL AS rank, module FROM x GROUP BY module, other, kind
            UNION ALL SELECT 'hot', item, NULL, n, unsure, rank, module FROM h WHERE rank <= 10
            UNION ALL SELECT 'cycle', a.other, NULL, a.n, a.unsure, NULL, a.module FROM p a JOIN p b ON b.module = a.other AND b.other = a.module
                WHERE a.n < b.n OR (a.n = b.n AND a.module > b.module))"""
    ),
}

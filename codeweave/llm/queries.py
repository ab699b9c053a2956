"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from codeweave.llm import bpe, chat, divergence, exact_dedup, licenses, minhash, packing, quality, simhash, substring_dedup, topk, toxicity
from codeweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], told.schema)
    return chat.digests(told.unionByName(tricky))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="last")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=(17, 20), width=5)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_licenses": op10_licenses,
    "op11_minhash": op11_minhash,
    "op12_divergence": op12_divergence,
}

#: The control strings of the chat template, as a pattern for SQL.
_MARK = r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|ROLE |/ROLE\])"

ORACLES: dict[str, str] = {
    "op3_chat": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (SELECT *, length(regexp_replace(text, '{_MARK}', '\1\\\2\3', 'g')) AS n FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 18
                ELSE 14 + length(replace(replace(role, '\', '\\'), ']', '\]')) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM p),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM x),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM m WHERE least < doc_id),
        r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
        a AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
        u AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS k FROM d),
        s AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY u.k) AS t FROM u LEFT JOIN g USING (doc_id, k) WHERE g.k IS NULL GROUP BY u.doc_id)
        SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM a LEFT JOIN s USING (doc_id)
    """,
    "op9_topk": """
        WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS m, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n AND len(c.x) = len(q.x)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
    """,
    "op11_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach)
        SELECT r.doc_id, coalesce(c.n, 0) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept FROM r LEFT JOIN c USING (doc_id) GROUP BY r.doc_id, c.n
    """,
    "op12_divergence": """
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS count FROM w GROUP BY ALL),
        a AS (SELECT g.lang, g.source, k.term, k.total, CAST(coalesce(c.count, 0) AS HUGEINT) AS count FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        n AS (SELECT *, CAST(sum(count) OVER (PARTITION BY lang, source) AS HUGEINT) AS n, CAST(count(*) OVER (PARTITION BY lang, source) AS HUGEINT) AS v,
            CAST(sum(total) OVER (PARTITION BY lang, source) AS HUGEINT) AS m FROM a),
        p AS (SELECT *, 1 + 1000000000 * (count + 2) // (n + 2 * v) AS p, 1 + 1000000000 * (total + 2) // (m + 2 * v) AS q FROM n),
        s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE count > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
}

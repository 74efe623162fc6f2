"""One registered query per training-data operator, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, exact_dedup, mixing, ngram_join, packing, quality, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_calls(*chat.turns_as_calls(table(spark, sf_dir, "conversations")), chat.REPLY)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
c0 AS (SELECT conv_id, turn, concat_ws(':', conv_id, turn) AS call_id, '{"prompt":' || to_json(coalesce(text, ''))::VARCHAR || ',"turn":' || turn || '}' AS args, length(coalesce(text, '')) > 0 AND turn >= 0 AS valid FROM t WHERE role = 'user'),
c AS (SELECT *, conv_id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS LAST, args) = 1 AS first FROM c0),
r0 AS (SELECT conv_id, turn, concat_ws(':', conv_id, turn - 1) AS call_id, text AS content FROM t WHERE role IS DISTINCT FROM 'user'),
r AS (SELECT *, conv_id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn NULLS LAST, content NULLS FIRST) = 1 AS first FROM r0),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn,
             CASE WHEN c.conv_id IS NULL THEN 'no_call' WHEN r.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status, c.valid, c.args, r.content
      FROM (SELECT * FROM c WHERE first) c FULL JOIN (SELECT * FROM r WHERE first) r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
      UNION ALL SELECT conv_id, call_id, turn, NULL, CASE WHEN conv_id IS NULL THEN 'no_result' ELSE 'duplicate_call' END, valid, args, NULL FROM c WHERE NOT first
      UNION ALL SELECT conv_id, call_id, NULL, turn, CASE WHEN conv_id IS NULL THEN 'no_call' ELSE 'duplicate_result' END, NULL, NULL, content FROM r WHERE NOT first),
k AS (SELECT conv_id, call_id, call_turn, result_turn, status, valid,
             '{"arguments":' || coalesce(args, 'null') || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || CASE WHEN args IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json FROM j)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(call_turn, result_turn), call_id, result_turn NULLS FIRST, status, json) - 1 AS position FROM k
"""

OP10_SQL = r"""
WITH b AS (SELECT page_id, sha256(html) AS sha, '"' || left(sha256(html), 16) || '"' AS tag, strlen(html) AS size,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
             regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
                             lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS tail FROM b),
k AS (SELECT page_id, sha, tag, size, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN tail = '' THEN '' ELSE '?' || tail END AS canonical_url FROM u),
v AS (SELECT *, 2 * (page_id + 1000) + 1 AS ts FROM k), f AS (SELECT *, 2 * page_id AS fts FROM k WHERE sha IS NOT NULL)
SELECT 2 * v.page_id + 1 AS record_id, v.canonical_url, 2 * f.page_id AS original_id,
       CASE WHEN f.page_id IS NULL THEN 'no_original' WHEN v.tag = f.tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       CASE WHEN v.tag = f.tag THEN 'content-length: ' || f.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || v.ts || chr(10) || 'etag: ' || v.tag END AS headers,
       CASE WHEN v.tag = f.tag THEN f.sha END AS payload_sha256
FROM v ASOF LEFT JOIN f ON v.canonical_url = f.canonical_url AND v.ts > f.fts
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_tool_linking": OP9_SQL, "op10_warc_revisits": OP10_SQL}

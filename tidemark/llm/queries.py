"""The operators' queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, lm, mixing, near, pii, secrets, tokens, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op3_token_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return tokens.packed(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(TOKENIZER))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of logarithms depend on their order in the last digits, so the query rounds to six."""
    rows = lm.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").filter("quality = 1"))
    return rows.select("doc_id", "n_tokens", *[(F.round(c, 6) + 0.0).alias(c) for c in ("loss_target", "loss_background", "score")])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "key", "found_id", "reason", F.col("headers").getItem("expires").alias("expires"), F.size("headers").cast("bigint").alias("n_headers"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_token_pack, op4_toxicity, op5_lm_score, op6_secret_scan, op7_decontaminate, op8_near_dedup, op9_warc_revisits, op10_mix)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_lm_score": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
        flagged AS (SELECT d.*, CAST(coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), FALSE) AS INT) AS t FROM d),
        tok AS (SELECT rid, t, CASE WHEN i > 1 THEN ws[i - 1] ELSE '<s>' END AS p, ws[i] AS c FROM (SELECT rid, t, ws, unnest(range(1, len(ws) + 1)) AS i FROM flagged)),
        cnt AS (SELECT c, count(*) AS n, sum(t) AS nt, count(*) - sum(t) AS nb FROM tok GROUP BY c),
        g AS (SELECT p, c, sum(t) AS nt, count(*) - sum(t) AS nb FROM tok GROUP BY p, c),
        head AS (SELECT p, sum(nt) AS ht, sum(nb) AS hb FROM g GROUP BY p),
        al AS (SELECT sum(n)::DOUBLE AS sn, sum(nt)::DOUBLE AS st, sum(nb)::DOUBLE AS sb, count(*) + 1 AS v FROM cnt),
        uni AS (SELECT c, CASE WHEN st > 0 THEN 0.9::DOUBLE * nt / st + 0.1::DOUBLE * (n + 1) / (sn + v) ELSE (n + 1) / (sn + v) END AS pt,
            CASE WHEN sb > 0 THEN 0.9::DOUBLE * nb / sb + 0.1::DOUBLE * (n + 1) / (sn + v) ELSE (n + 1) / (sn + v) END AS pb FROM cnt CROSS JOIN al),
        step AS (SELECT g.p, g.c, -ln(CASE WHEN ht > 0 THEN 0.6::DOUBLE * nt / ht + 0.4::DOUBLE * pt ELSE pt END) AS lt, -ln(CASE WHEN hb > 0 THEN 0.6::DOUBLE * nb / hb + 0.4::DOUBLE * pb ELSE pb END) AS lb
            FROM g JOIN head USING (p) JOIN uni USING (c)),
        each AS (SELECT rid, count(*) AS n, sum(lt) AS lt, sum(lb) AS lb FROM tok JOIN step USING (p, c) GROUP BY rid)
        SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(lt / n, 0), 6) + 0.0::DOUBLE AS loss_target, round(coalesce(lb / n, 0), 6) + 0.0::DOUBLE AS loss_background, round(coalesce((lb - lt) / n, 0), 6) + 0.0::DOUBLE AS score
        FROM d LEFT JOIN each USING (rid)""",
    "op7_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
        s AS (SELECT item, ws, least(len(ws), 8) AS n FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM s)),
        grams AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
        hit AS (SELECT g.rid, g.i, g.n, w.item FROM grams g JOIN win w ON w.n = g.n AND w.gram = g.gram),
        cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
        its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)""",
    "op9_warc_revisits": r"""
        WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, md5(coalesce(html, '')) AS tag FROM pages),
        rec AS (
            SELECT 'r' || page_id AS record_id, TRUE AS is_full, url, page_id * 10000 AS ts, tag AS etag, page_id % 2 = 0 AS dated, '0' AS expires FROM p
            UNION ALL SELECT 'l' || page_id, FALSE, url, page_id * 10000 + 4000, CASE WHEN page_id % 7 = 0 THEN 'stale' ELSE tag END, FALSE, CAST(page_id AS VARCHAR) FROM p
            UNION ALL SELECT 'e' || page_id, FALSE, url, page_id * 10000 - 1000, NULL, TRUE, NULL FROM p),
        parts AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM rec),
        keyed AS (SELECT *,
            regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
            || regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN regexp_extract(bare, '\?(.*)$', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') ELSE '' END AS key FROM parts),
        seen AS (SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'etag': etag, 'dated': dated} END IGNORE NULLS)
            OVER (PARTITION BY key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM keyed),
        said AS (SELECT *, CASE WHEN old IS NULL THEN 'no earlier response' WHEN etag IS NOT NULL AND old.etag <> etag THEN 'validator differs'
            WHEN etag IS NULL AND NOT (dated AND old.dated) THEN 'no validator' ELSE 'resolved' END AS reason FROM seen WHERE NOT is_full)
        SELECT record_id, key, CASE WHEN reason = 'resolved' THEN old.id END AS found_id, reason,
               CASE WHEN reason = 'resolved' THEN coalesce(expires, '0') ELSE expires END AS expires,
               CAST(CASE WHEN reason = 'resolved' THEN 3 + CAST(old.dated AS INT) WHEN etag IS NULL THEN 1 ELSE 3 END AS BIGINT) AS n_headers
        FROM said""",
}

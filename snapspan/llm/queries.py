"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapspan.llm import divergence, golay, media, near, packing, phrases, pieces, pii, quality, secrets, simhash, suffix, toxicity
from snapspan.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_copies(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_quality, op3_suffix, op4_toxicity, op5_media, op6_sentencepiece, op7_simhash, op8_near_dedup, op9_packing, op10_secrets, op11_phrases, op12_divergence, op13_golay)}
ORACLES: dict[str, str] = {
    "op11_phrases": phrases.SQL,
    "op12_divergence": divergence.SQL,
    "op3_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT doc_id, i, hash(substr(h, 2 * i - 1, 400)) AS k FROM d, unnest(range(1, n - 198)) t(i) WHERE n >= 200),
 again AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) r USING (k)),
 run AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM (
   SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
     SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again) x) y GROUP BY doc_id, g),
 edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER o, 0) + 1 AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM run WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
 cut AS (SELECT e.doc_id, sum(b - a + 1)::BIGINT AS gone, count(*) AS spans,
   string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a) || max(CASE WHEN back = 1 THEN substr(h, 2 * b + 1) END) AS kept
   FROM edge e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id""",
    "op8_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
   JOIN n i ON i.doc_id = p.a JOIN n j ON j.doc_id = p.b WHERE 100 * both_ >= 85 * (i.n + j.n - both_)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = d.doc_id""",
}

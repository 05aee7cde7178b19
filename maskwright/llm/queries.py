"""Registered queries of the training-text operators, and their checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, edit_counts, langid, negatives, packing, quality, sharding, simhash, token_store, toxicity, urls, vectors, whitening
from maskwright.llm.common import table
from maskwright.sources.staging import shared_folder


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("mark")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/maskwright-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.document_digests(spark, path)


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_with_edits(table(spark, sf_dir, "documents"), edit_counts.revision_edits(F.col("text")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shifted = table(spark, sf_dir, "embeddings"), (F.col("label") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, shifted).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), "embedding"))


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))
    return judged.drop("trust", "distrust")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_decontamination, op3_token_store, op4_edit_counts, op5_sharding,
        op6_simhash, op7_quality, op8_language, op9_near_vectors, op10_toxicity,
        op11_whitening, op12_hard_negatives, op13_url_filters,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS k, ws[i:i + least(len(ws), 13) - 1] AS w
       FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS w
       FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op12_hard_negatives": """
WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE k <= 5""",
    "op13_url_filters": rf"""
WITH RECURSIVE rules(verdict, rule_host, rule_path) AS (VALUES {', '.join(str(tuple(r)) for r in URL_RULES)}),
u AS (
    SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
    SELECT row, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (
    SELECT row, verdict, rule_host || rule_path AS rule FROM p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) = 1),
j AS (SELECT p.*, verdict, rule FROM p LEFT JOIN fit USING (row)),
e AS (
    SELECT host AS src, translate(regexp_extract(link, '^[^/]*//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS link FROM p)),
pairs AS (SELECT src, dst, count(*) AS links FROM e WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
edges AS (SELECT 'trust' AS kind, src, dst, links FROM pairs UNION ALL SELECT 'distrust', dst, src, links FROM pairs),
shares AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) * {urls.DAMPING} AS share FROM edges),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
walk(step, kind, node, mass) AS (
    (SELECT 0, 'trust', host, CAST(1 AS DOUBLE) FROM hosts WHERE good > 0 AND good >= {urls.SEED_SHARE} * n
     UNION ALL SELECT 0, 'distrust', host, CAST(1 AS DOUBLE) FROM hosts WHERE bad > 0 AND bad >= {urls.SEED_SHARE} * n)
    UNION ALL
    SELECT step + 1, w.kind, dst, sum(mass * share) FROM walk w JOIN shares s ON w.kind = s.kind AND w.node = s.src
    WHERE step < {urls.STEPS} GROUP BY step + 1, w.kind, dst),
scores AS (SELECT node, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM walk GROUP BY node)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN distrust >= {urls.LEAST} AND distrust >= {urls.THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN scores ON host = node""",
}

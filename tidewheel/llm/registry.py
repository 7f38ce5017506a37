"""Queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, html_text, langid, licenses, mixing, packing, sharding, simhash, urls, vectors
from .store import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op1"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op2"))


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op3"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), Workspace(spark, "op5"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_paths(_table(spark, sf_dir, "documents"))
    found = licenses.scan(files, Workspace(spark, "op8"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"([0-9-]+)\.txt$", 1).cast("long"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"), Workspace(spark, "op10"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_vectors, op3_exact, op4_mixing, op5_urls, op6_packing, op7_sharding, op8_licenses, op9_language, op10_html)}

ORACLES = {
    "op2_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        l AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ),
        r AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION
            SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
        ),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT r.x AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept
        FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x
    """,
    # The level by rounds: sources that it leaves above their cap are full, and the others share the rest anew.
    "op4_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % 4096 AS bucket,
                   ('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % 1048576 AS die
            FROM documents
        ),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
        l AS (
            SELECT 0 AS round, sum(source_size) / sum(weight) AS level FROM w
            UNION ALL
            SELECT n.round, n.level FROM (
                SELECT l.round + 1 AS round, l.level AS old,
                       ((SELECT sum(source_size) FROM w) - coalesce((SELECT sum(cap) FROM w WHERE cap < l.level * weight), 0)) / nullif((SELECT sum(weight) FROM w WHERE cap >= l.level * weight), 0) AS level
                FROM l
            ) n WHERE n.level > n.old
        ),
        t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM w),
        e AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
        b AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, bucket),
        c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
        k AS (
            SELECT e.source, min(c.bucket) AS cut, arg_min((e.target - e.whole * e.source_size - c.before) / c.words, c.bucket) AS part
            FROM e JOIN c ON c.source IS NOT DISTINCT FROM e.source AND c.before <= e.target - e.whole * e.source_size AND c.before + c.words > e.target - e.whole * e.source_size
            GROUP BY e.source
        ),
        p AS (SELECT e.*, coalesce(k.cut, 0) AS cut, coalesce(k.part, 0) AS part FROM e LEFT JOIN k ON k.source IS NOT DISTINCT FROM e.source),
        r AS (
            SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole + CASE WHEN d.bucket < p.cut THEN 1 ELSE 0 END AS copies,
                   CASE WHEN d.bucket = p.cut THEN least(d.size, CAST(floor(d.size * p.part + d.die / 1048576.0::DOUBLE) AS BIGINT)) ELSE 0 END AS extra
            FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source
        )
        SELECT doc_id, source, size, source_size, target, size * copies + extra AS taken, copies FROM r
    """,
    "op3_exact": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
}

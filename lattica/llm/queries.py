"""The queries of the corpus operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "slot")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), train=crc_mod(F.col("doc_id"), 5) != 1)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_RULES, find_secrets

    base = [r.kind for r in BASE_RULES]
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, table(spark, sf_dir, "labels"), held_out=crc_mod(F.col("doc_id"), 4) == 2)
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    from .decontaminate import find_items

    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    m = found.select("doc_id", F.explode("matches").alias("m"))
    return m.select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.distance").alias("distance"), F.col("m.end").alias("end_at"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_removed").cast("long").alias("n_removed"))


def op9_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP8_SQL = r"""
WITH pieces AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), lines AS (SELECT *, trim(raw, ' ') AS line FROM pieces),
bad AS (
  SELECT line FROM lines WHERE length(line) >= 1 GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
), marked AS (
  SELECT l.*, b.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) > 1 AS gone
  FROM lines l LEFT JOIN bad b ON l.line = b.line
)
SELECT doc_id, source, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  CAST(length(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS BIGINT) AS n_chars,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed
FROM marked GROUP BY doc_id, source
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets), pairs AS (
  SELECT a.r AS a, b.r AS b FROM items a JOIN items b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(r, x) AS (
  SELECT r, r FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.x
)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.r JOIN sets t ON t.r = reach.x GROUP BY reach.r
"""

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts
), hp AS (
  SELECT page_id, url, lower(h) AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split
), site(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, host, path, url, arg_max(s.h || s.p, length(s.h || s.p)) AS rule, arg_max(s.verdict, length(s.h || s.p)) AS v
  FROM hp LEFT JOIN site s ON (host = s.h OR ends_with(host, '.' || s.h)) AND starts_with(path, s.p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN
    (regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(cheap-pills|free-bets|casino-win|ads-track|spam-farm|adult-x|doubleclick|adserver)\.')
     OR regexp_matches(lower(url), '/banner-ads/|/wp-login\.php([^a-z0-9_.%-]|$)|/phishing/|\?affid='))
    AND NOT regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org[^a-z0-9_.%-].*/about/') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_main_text": op2_main_text,
    "op3_permutation_index": op3_permutation_index,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_groups": op9_ngram_groups,
    "op10_url_filter": op10_url_filter,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op8_line_dedup": OP8_SQL,
    "op9_ngram_groups": OP9_SQL,
    "op10_url_filter": OP10_SQL,
}

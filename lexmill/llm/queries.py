"""The queries opN_<name> over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import gnat, hnsw, langid, minhash, mixing, packing, pii, secret_scan, sharding, simhash, urls, vafile, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op1_minhash_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON s.doc_id = l.x
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@_query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


RULES = [
    urls.Rule.of("allow", "org/"), urls.Rule.of("block", "example.org/es/"), urls.Rule.of("block", "example.org/en/1"),
    urls.Rule.of("allow", "com/fr/"), urls.Rule.of("block", "com/de/"),
]
# A small table of labelled URLs beside those that the rules decide: every word of a list as host and as path.
BLOCKED_WORDS = "spam spam-farm casino poker pills viagra porn xxx warez torrent crack free-money lottery payday click-bait".split()
ALLOWED_WORDS = "www blog m news docs wiki library museum university school journal weather travel recipes history".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{w}.{site}/{path}", label)
            for words, label in ((BLOCKED_WORDS, "block"), (ALLOWED_WORDS, "allow"))
            for w in words for site in ("example.com", "example.net", "example.org") for path in ("", f"en/{w}/1")]
    return spark.createDataFrame(rows, "url string, label string")


@_query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, labelled_urls(spark))


@_query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@_query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


@_query("op7_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vafile.integer_vector(F.col("embedding")).alias("vector"))
    found = vafile.top_k(rows, F.col("vec_id") % 50 == 0, k=5)
    return found.withColumn("score", F.col("score").cast("bigint"))


@_query("op8_mixing", r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS bound FROM s),
o AS (
  SELECT *, coalesce(sum(bound) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_sum,
    coalesce(sum(w) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w
  FROM w),
lev AS (SELECT *, (total - full_sum) / (all_w - used) AS level FROM o),
cut AS (SELECT coalesce(min_by(level, used) FILTER (level * w <= bound), 0) AS level FROM lev),
t AS (SELECT source, source_size, least(bound, cut.level * w) AS target FROM lev, cut),
b AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS times FROM t),
g AS (SELECT d.source, d.h, CAST(sum(d.size) AS BIGINT) AS n FROM d GROUP BY d.source, d.h),
r AS (
  SELECT g.source, g.h, g.n, b.target - b.times * b.source_size AS budget,
    CAST(sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS BIGINT) AS upto
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
z AS (SELECT source, h, budget > 0 AND (upto < budget OR (upto - n < budget AND upto - budget < budget - (upto - n))) AS more FROM r)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.times + CAST(z.more AS BIGINT)) AS taken, CAST(b.times + CAST(z.more AS BIGINT) AS INTEGER) AS copies
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.h = z.h
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return hnsw.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


@_query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024, added=True)


@_query("op11_simhash_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT o.anchor_id, o.vec_id AS positive_id, s.vec_id AS negative_id, o.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY o.anchor_id, o.vec_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM o JOIN s ON o.k <= 5 AND o.anchor_id = s.anchor_id AND NOT s.same AND 30 * o.score <= 100 * s.score AND 100 * s.score <= 90 * o.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), vafile.integer_vector(F.col("embedding")).alias("vector"))
    found = gnat.hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("positive_score", "negative_score")})


@_query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), misspelt=199)

"""Queries over raw pages and scraped articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import html as hx
from lexmill.functions import text as tx
from lexmill.operators import pages as pg
from lexmill.plans import sqlparts as sq
from lexmill.plans.registry import query, table

ARTICLE, HEADING, BODY = ("article", None), ("h1", None), ("body", None)


def _decoded(expr: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


def _seen_html(expr: str) -> str:
    e = rf"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    return rf"regexp_replace({e}, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g')"


def _visible(expr: str) -> str:
    nodes = f"string_split_regex({_seen_html(expr)}, '<[^>]*>')"
    return f"""array_to_string(list_filter(list_transform({nodes}, lambda t: {sq.strip(_decoded('t'))}),
      lambda t: t <> ''), chr(10))"""


def _raw(expr: str) -> str:
    return f"array_to_string(list_transform(string_split_regex({_seen_html(expr)}, '<[^>]*>'), lambda t: {_decoded('t')}), '')"


_ARTICLE = r"regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)"
_HEADING = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query(
    "drop_missing_pages",
    f"SELECT page_id, url FROM pages WHERE html IS NOT NULL AND html <> '' AND NOT contains({_raw('html')}, 'Ist')",
)
def drop_missing_pages(spark, sf):
    return pg.drop_missing_pages(table(spark, sf, "pages"), "Ist").select("page_id", "url")


@query("visible_text", f"SELECT page_id, {_visible('html')} AS text FROM pages")
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", hx.visible_text(F.col("html")).alias("text"))


@query(
    "extract_links",
    rf"""SELECT page_id, CAST(n - 1 AS INTEGER) AS link_no,
    regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) || href AS link
    FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS n FROM (
      SELECT page_id, url, list_filter(list_transform(regexp_extract_all(
        {_seen_html(r"regexp_extract(html, '(?is)<body[^>]*>(.*)', 1)")}, 'href="([^"]*)"', 1),
        lambda x: {_decoded('x')}), lambda x: contains(x, '/') AND NOT contains(x, 'the')) AS h FROM pages))""",
)
def extract_links(spark, sf):
    return pg.extract_links(table(spark, sf, "pages"), BODY, "/", ("the",))


@query(
    "extract_article",
    f"""SELECT page_id, url, {sq.strip(_decoded(rf"regexp_replace({_HEADING}, '<[^>]*>', '', 'g')"))} AS title,
    {_visible(_ARTICLE)} AS content FROM pages""",
)
def extract_article(spark, sf):
    return pg.extract_article(table(spark, sf, "pages"), ARTICLE, HEADING)


@query(
    "safe_title",
    rf"""SELECT page_id, regexp_replace(regexp_replace({sq.strip(_decoded(_HEADING))}, '[^\p{{L}}\p{{N}} _-]', '', 'g'),
    '[{sq.SPACE}]+\z', '') AS title FROM pages""",
)
def safe_title(spark, sf):
    articles = pg.extract_article(table(spark, sf, "pages"), ARTICLE, HEADING)
    return articles.select("page_id", tx.safe_title(F.col("title")).alias("title"))


@query(
    "seen_url_skip",
    """SELECT url FROM (SELECT DISTINCT url FROM pages) WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""",
)
def seen_url_skip(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pg.skip_seen(pages, pages.where("page_id % 3 = 0")).select("url")


@query(
    "articles_by_part",
    """SELECT volume, part, safe_title, page_id FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY volume, part, safe_title ORDER BY page_id DESC) AS rn FROM (
      SELECT page_id % 4 AS volume, page_id % 8 AS part, page_id,
        regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '[^\\p{L}\\p{N} _-]', '', 'g') AS safe_title
      FROM pages)) WHERE rn = 1""".replace("\\\\", "\\"),
)
def articles_by_part(spark, sf):
    host = tx.safe_title(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1))
    articles = table(spark, sf, "pages").select(
        (F.col("page_id") % 4).alias("volume"), (F.col("page_id") % 8).alias("part"), "page_id",
        host.alias("title"),
    )
    return pg.articles_by_part(articles, ts="page_id").select("volume", "part", "safe_title", "page_id")


@query(
    "ingest_rate",
    """SELECT time_bucket(INTERVAL '1 minute', ts) AS start, COUNT(*) AS n FROM events GROUP BY 1""",
)
def ingest_rate(spark, sf):
    return pg.ingest_rate(table(spark, sf, "events"))


@query(
    "ingest_progress",
    """WITH b AS (SELECT COUNT(*) AS processed, (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 60e6 AS m FROM events)
    SELECT processed, ROUND(m, 6) AS elapsed_minutes, ROUND(processed / m, 6) AS per_minute,
    ROUND((1000000 - processed) / (processed / m), 4) AS eta_minutes FROM b""",
)
def ingest_progress(spark, sf):
    df = pg.ingest_progress(table(spark, sf, "events"), 1_000_000)
    return df.select(
        "processed", F.round("elapsed_minutes", 6).alias("elapsed_minutes"),
        F.round("per_minute", 6).alias("per_minute"), F.round("eta_minutes", 4).alias("eta_minutes"),
    )


# Scraped articles made from documents: every seventh sits in the index part, some are index pages.
_SCRAPED = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'vol/part_01/' ELSE 'vol/part_02/' END AS path,
  CASE WHEN doc_id % 14 = 0 THEN '1911 Encyclopædia Britannica.json'
    WHEN doc_id % 21 = 0 THEN '1911 Encyclopædia BritannicaVol 3 A to B.json' ELSE source || '.json' END AS name,
  CASE WHEN doc_id % 5 = 0 THEN text ELSE 'Head Volume 1 of Volume 3 — ' || text END AS content FROM documents)"""


def _scraped(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 7 == 0, F.lit("vol/part_01/")).otherwise(F.lit("vol/part_02/")).alias("path"),
        F.when(d % 14 == 0, F.lit(pg.INDEX_NAME))
        .when(d % 21 == 0, F.lit("1911 Encyclopædia BritannicaVol 3 A to B.json"))
        .otherwise(F.concat("source", F.lit(".json"))).alias("name"),
        F.when(d % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("Head Volume 1 of Volume 3 — "), "text")).alias("content"),
    )


_BODY = f"""CASE WHEN len(string_split(content, 'Volume')) < 3 THEN '' ELSE {sq.strip(
    "CASE WHEN instr(p, '—') > 0 THEN substr(p, instr(p, '—') + 1) ELSE p END")} END"""
_SKIP = r"""(contains(path, 'part_01') AND (name = '1911 Encyclopædia Britannica.json'
  OR regexp_matches(name, '^1911 Encyclopædia BritannicaVol \d+ .+ to .+\.json')))"""


@query(
    "skip_index_pages",
    f"SELECT doc_id, name FROM {_SCRAPED} WHERE NOT {_SKIP}",
)
def skip_index_pages(spark, sf):
    return _scraped(spark, sf).where(~pg.index_page(F.col("path"), F.col("name"))).select("doc_id", "name")


@query(
    "extract_body",
    f"""SELECT doc_id, {_BODY} AS body FROM (SELECT *, string_split(content, 'Volume')[3] AS p FROM {_SCRAPED})""",
)
def extract_body(spark, sf):
    return _scraped(spark, sf).select("doc_id", pg.extract_body(F.col("content")).alias("body"))


@query(
    "conversion_counts",
    f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (s) AS skipped, COUNT(*) FILTER (NOT s) AS processed,
    COUNT(*) FILTER (NOT s AND b = '') AS empty, COUNT(*) FILTER (NOT s AND b <> '') AS converted
    FROM (SELECT {_SKIP} AS s, {_BODY} AS b FROM (SELECT *, string_split(content, 'Volume')[3] AS p FROM {_SCRAPED}))""",
)
def conversion_counts(spark, sf):
    return pg.conversion_counts(_scraped(spark, sf))

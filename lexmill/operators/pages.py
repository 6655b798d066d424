"""Raw pages to articles, and conversion of scraped articles to body text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import html as hx
from lexmill.functions import text as tx

# Fixed values of the encyclopedia the operators were made for; every one is a parameter below.
NOT_FOUND = "Wikisource does not have a text with this exact name"
CONTAINER = ("div", r"\sclass\s*=\s*[\"'](?:[^\"']*\s)?mw-parser-output(?:\s[^\"']*)?[\"']")
TITLE = ("h1", r"\sid\s*=\s*[\"']firstHeading[\"']")
LINK_PART = "/wiki/"
LINK_STOP = ("File:", "Category:", "Template:", "Help:", "Vol_")
INDEX_PART = "part_01"
INDEX_NAME = "1911 Encyclopædia Britannica.json"
INDEX_PATTERN = r"^1911 Encyclopædia BritannicaVol \d+ .+ to .+\.json"
BODY_MARK = "Volume"


def drop_missing_pages(pages: DataFrame, message: str = NOT_FOUND, html: str = "html") -> DataFrame:
    """Pages that have HTML and whose text, read through inline tags, does not contain the not-found message."""
    present = F.col(html).isNotNull() & (F.col(html) != "")
    return pages.where(present & ~hx.raw_text(F.col(html)).contains(message))


def extract_links(
    pages: DataFrame, container: tuple[str, str | None] = CONTAINER, part: str = LINK_PART,
    stop: tuple[str, ...] = LINK_STOP, base: Column | None = None, keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """(keys, link_no, link): links of the container that contain ``part`` and no ``stop`` text.

    Order and duplicates are kept; links are resolved against ``base`` (default: the page's URL).
    """
    wanted = F.filter(
        hx.hrefs(hx.container(F.col("html"), *container)),
        lambda h: h.contains(part) & ~F.exists(F.array(*[F.lit(s) for s in stop]), lambda s: h.contains(s)),
    )
    base = F.col("url") if base is None else base
    return pages.select(*keys, base.alias("_base"), F.posexplode_outer(wanted).alias("link_no", "_href")).where("_href is not null").select(
        *keys, "link_no", hx.resolve_url(F.col("_base"), F.col("_href")).alias("link")
    )


def extract_article(
    pages: DataFrame, container: tuple[str, str | None] = CONTAINER, title: tuple[str, str | None] = TITLE
) -> DataFrame:
    """Title and content (text nodes joined by line ends); pages without container are dropped."""
    inner = hx.container(F.col("html"), *container)
    heading = tx.strip(F.array_join(F.transform(
        F.split(hx.container(F.col("html"), *title), r"<[^>]*>"), hx.decode_references), ""))
    return (
        pages.withColumn("_inner", inner).where("_inner is not null")
        .withColumns({"title": F.coalesce(heading, F.lit("")), "content": F.array_join(hx.text_nodes(F.col("_inner")), "\n")})
        .drop("_inner", "html")
    )


def skip_seen(pages: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """First row of every URL that is not in ``seen``; URLs are compared as they are."""
    return pages.join(seen.select(url).distinct(), url, "left_anti").dropDuplicates([url])


def articles_by_part(articles: DataFrame, ts: str = "ts") -> DataFrame:
    """One article per (volume, part, safe title): the one written last."""
    safe = articles.withColumn("safe_title", tx.safe_title(F.col("title")))
    columns = [c for c in safe.columns if c not in ("volume", "part", "safe_title")]
    return (
        safe.groupBy("volume", "part", "safe_title")
        .agg(F.max_by(F.struct(*columns), F.struct(ts, *[c for c in columns if c != ts])).alias("a"))
        .select("volume", "part", "safe_title", "a.*")
    )


def ingest_rate(events: DataFrame, ts: str = "ts", width: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), *keys, "n"
    )


def ingest_progress(events: DataFrame, total: int, ts: str = "ts") -> DataFrame:
    """Processed rows, elapsed minutes, rows per minute, minutes to go (NULL at rate 0)."""
    elapsed = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / F.lit(60e6)
    base = events.agg(F.count(F.lit(1)).alias("processed"), elapsed.alias("elapsed_minutes"))
    rate = F.when(F.col("elapsed_minutes") > 0, F.col("processed") / F.col("elapsed_minutes")).otherwise(0.0)
    return base.withColumn("per_minute", rate).withColumn(
        "eta_minutes", F.when(F.col("per_minute") > 0, (F.lit(total) - F.col("processed")) / F.col("per_minute"))
    )


def index_page(path: Column, name: Column, part: str = INDEX_PART, exact: str = INDEX_NAME,
               pattern: str = INDEX_PATTERN) -> Column:
    return path.contains(part) & ((name == exact) | name.rlike(pattern))


def extract_body(text: Column, mark: str = BODY_MARK) -> Column:
    """Text behind the second ``mark`` (up to the third), after its first em dash if it has one."""
    part = F.get(F.split(text, rf"\Q{mark}\E"), F.lit(2))
    dash = F.instr(part, "—")
    body = F.when(dash > 0, F.substring(part, dash + 1, F.length(part))).otherwise(part)
    return F.coalesce(tx.strip(body), F.lit(""))


def conversion_counts(articles: DataFrame, path: str = "path", name: str = "name", content: str = "content",
                      **rules: str) -> DataFrame:
    """Total, skipped, processed, empty and converted articles in one pass."""
    skipped = index_page(F.col(path), F.col(name), **{k: v for k, v in rules.items() if k != "mark"})
    body = extract_body(F.col(content), rules.get("mark", BODY_MARK))
    flags = articles.select(
        F.coalesce(skipped, F.lit(False)).alias("s"), (F.coalesce(body, F.lit("")) == "").alias("e")
    )
    return flags.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("s").alias("skipped"), F.count_if(~F.col("s")).alias("processed"),
        F.count_if(~F.col("s") & F.col("e")).alias("empty"), F.count_if(~F.col("s") & ~F.col("e")).alias("converted"),
    )

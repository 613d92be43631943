"""Normalisation of entries, addresses and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..sources import entries as e
from . import sql
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("n01_normalize_whitespace", rf"SELECT doc_id, {sql.squeeze('text')} AS squeezed FROM documents")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "documents").select("doc_id", t.squeeze(F.col("text")).alias("squeezed"))


@query("n02_canonical_url", f"SELECT page_id, {sql.canonical('url')} AS canonical_url FROM pages")
def n02(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query("n03_normalize_title", sql.ENTRY + f" SELECT id, {sql.plain_title('title')} AS normalized_title FROM entry")
def n03(spark: SparkSession, d: str) -> DataFrame:
    return e.entries(spark, d).select("id", t.plain_title(F.col("title")).alias("normalized_title"))


@query("n04_keywords", sql.KEYWORDS + " SELECT id, array_to_string(keywords, '|') AS keywords FROM full_article")
def n04(spark: SparkSession, d: str) -> DataFrame:
    return e.with_keywords(e.articles(spark, d)).select("id", t.joined(F.col("keywords")).alias("keywords"))


@query("n05_entities", sql.ARTICLE + " SELECT id, array_to_string(entities, '|') AS entities FROM article")
def n05(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).select("id", t.joined(F.col("entities")).alias("entities"))


def parsed_time(text, as_of: str = e.AS_OF):
    """A time from ISO-8601 text, UTC without an offset; empty is ``as_of``, anything else that fails is null."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(as_of).cast("timestamp")).otherwise(text.try_cast("timestamp"))


_RAW = "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'not a time' WHEN event_id % 7 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query("n06_published_at", f"WITH r AS (SELECT event_id, {_RAW} AS raw FROM events) SELECT event_id, CASE WHEN raw = '' THEN '2024-02-01 00:00:00' ELSE strftime(TRY_CAST(replace(replace(raw, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS published_at, raw <> '' AND TRY_CAST(replace(replace(raw, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NULL AS malformed FROM r")
def n06(spark: SparkSession, d: str) -> DataFrame:
    n, ts = F.col("event_id") % 7, F.col("ts").cast("timestamp")
    raw = F.when(n == 0, "").when(n == 1, "not a time").when(n == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    rows = e.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.date_format(parsed_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("published_at"), parsed_time(F.col("raw")).isNull().alias("malformed"))


@query("n07_dedupe_hash", sql.ARTICLE + " SELECT id, dedupe_hash FROM normal")
def n07(spark: SparkSession, d: str) -> DataFrame:
    return e.normalized(e.entries(spark, d)).select("id", "dedupe_hash")


@query("n08_publisher", sql.ENTRY + " SELECT id, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN '' ELSE publisher END), ''), nullif(CASE WHEN id % 2 = 0 THEN category ELSE '' END, ''), 'unknown') AS publisher FROM entry")
def n08(spark: SparkSession, d: str) -> DataFrame:
    title, author = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("publisher")), F.when(F.col("id") % 2 == 0, F.col("category")).otherwise("")
    return e.entries(spark, d).select("id", F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(author, F.lit("")), F.lit("unknown")).alias("publisher"))


@query("n09_image_url_valid", f"SELECT page_id, regexp_matches({sql.squeeze('url')}, '^https?://[^/?#]+') AS valid FROM pages")
def n09(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "pages").select("page_id", urls.is_image_url(F.col("url")).alias("valid"))


def html_tags(pages: DataFrame) -> DataFrame:
    """One row for each meta and img tag of a page: its place, kind, name and content."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)(<(?:meta|img)\b[^>]*>)"), 1)).alias("place", "tag"))

    def attribute(names: str):
        return F.coalesce(F.nullif(F.regexp_extract("tag", rf'(?i)\b(?:{names})\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("tag", rf"(?i)\b(?:{names})\s*=\s*'([^']*)'", 1), F.lit("")), F.lit(""))

    return tags.select("page_id", "place", F.lower(F.regexp_extract("tag", "(?i)^<([a-z]+)", 1)).alias("kind"), attribute("name|property|charset").alias("name"), attribute("content|src").alias("content"))


def _attribute_sql(names: str) -> str:
    return rf"""coalesce(nullif(regexp_extract(tag, '(?i)\b(?:{names})\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?i)\b(?:{names})\s*=\s*''([^'']*)''', 1), ''), '')"""


@query("n11_html_tags", r"WITH t AS (SELECT page_id, regexp_extract_all(html, '(?i)<(?:meta|img)\b[^>]*>') AS l FROM pages), u AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS place FROM t) SELECT page_id, CAST(place AS INTEGER) AS place, lower(regexp_extract(tag, '(?i)^<([a-z]+)', 1)) AS kind, " + _attribute_sql("name|property|charset") + " AS name, " + _attribute_sql("content|src") + " AS content FROM u")
def n11(spark: SparkSession, d: str) -> DataFrame:
    return html_tags(e.table(spark, d, "pages"))


def image_of(rows: DataFrame) -> DataFrame:
    """(id, image_url): the first valid candidate of each entry, without its fragment.

    Candidates in order: the entry's own fields, thumbnails, media and links and enclosures that are images, the
    page's preview image, its first img.
    """

    def images(items, address, kind):
        by_name = F.lower(F.regexp_extract(address, r"^[^?#]*(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin(".apng", ".avif", ".gif", ".jpeg", ".jpg", ".png", ".webp")
        return F.when(F.lower(F.coalesce(kind, F.lit(""))).startswith("image/") | ((F.coalesce(kind, F.lit("")).isin("", "application/octet-stream")) & by_name), address)

    own = F.array("image_url", "lead_image_url", "thumbnail_url")
    thumbs = F.transform("media_thumbnail", lambda m: m["url"])
    media = F.transform("media_content", lambda m: F.when(F.lower(m["medium"]) == "image", m["url"]).otherwise(images(None, m["url"], m["type"])))
    linked = F.transform("links", lambda m: images(None, m["href"], m["type"]))
    enclosed = F.transform("enclosures", lambda m: images(None, m["url"], m["mime_type"]))
    metas = F.filter(F.regexp_extract_all("content", F.lit(r"(?i)(<meta\b[^>]*>)"), 1), lambda m: m.rlike(r"(?i)(og:image|twitter:image|twitter:image:src)[\"']"))
    shown = F.transform(metas, lambda m: F.regexp_extract(m, r"(?i)\bcontent\s*=\s*[\"']([^\"']*)", 1))
    pictured = F.transform(F.regexp_extract_all("content", F.lit(r"(?i)(<img\b[^>]*>)"), 1), lambda m: F.regexp_extract(m, r"(?i)\bsrc\s*=\s*[\"']([^\"']*)", 1))
    empty = F.array().cast("array<string>")
    all_ = F.concat(*(F.coalesce(c, empty) for c in (own, thumbs, media, linked, enclosed, shown, pictured)))
    good = F.filter(F.transform(all_, lambda u: t.squeeze(F.replace(u, F.lit("&amp;"), F.lit("&")))), urls.is_image_url)
    return rows.select("id", F.try_element_at(F.transform(good, urls.without_fragment), F.lit(1)).alias("image_url"))


@query("n12_normalized_article", sql.ARTICLE + f" SELECT id, title, url, canonical_url, publisher, {sql.stamp('published_at')} AS published_at, content, normalized_title, array_to_string({sql.entities('keyword_text')}, '|') AS entities, dedupe_hash FROM normal")
def n12(spark: SparkSession, d: str) -> DataFrame:
    return e.normalized(e.entries(spark, d)).select("id", "title", "url", "canonical_url", "publisher", F.date_format("published_at", STAMP).alias("published_at"), "content", "normalized_title", t.joined(F.col("entities")).alias("entities"), "dedupe_hash")


@query("n13_url_key", f"SELECT page_id, lower({sql.canonical(sql.squeeze('url'))}) AS url_key FROM pages")
def n13(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query("n14_category", sql.ENTRY + " SELECT id, coalesce(nullif(trim(CASE WHEN id % 4 = 0 THEN ' ' ELSE category END), ''), nullif(CASE WHEN id % 8 = 0 THEN 'World' END, ''), 'Uncategorized') AS category FROM entry")
def n14(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("category")), F.when(F.col("id") % 8 == 0, "World")
    return e.entries(spark, d).select("id", F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(second, F.lit("")), F.lit("Uncategorized")).alias("category"))


@query("n15_entry_time", f"WITH r AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS a, CASE WHEN event_id % 6 > 0 THEN ts - INTERVAL 1 HOUR END AS b FROM events) SELECT event_id, {sql.stamp('coalesce(a, b, TIMESTAMP ' + chr(39) + e.AS_OF + chr(39) + ')')} AS entry_time FROM r")
def n15(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    a, b = F.when(F.col("event_id") % 3 > 0, ts), F.when(F.col("event_id") % 6 > 0, ts - F.expr("INTERVAL 1 HOUR"))
    return e.table(spark, d, "events").select("event_id", F.date_format(F.coalesce(a, b, F.lit(e.AS_OF).cast("timestamp")), STAMP).alias("entry_time"))


@query("n16_entry_key", sql.ENTRY + " SELECT id, lower(trim(coalesce(nullif(url, ''), CAST(id AS VARCHAR)))) AS entry_key FROM entry")
def n16(spark: SparkSession, d: str) -> DataFrame:
    return e.entries(spark, d).select("id", F.lower(F.trim(F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("id").cast("string")))).alias("entry_key"))


def _redacted_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '(?i)(https?://)[^/\s:@]+:[^/\s@]+@', '\1<redacted>@', 'g'), '(?i)\b(api[_-]?key|auth[_-]?token|authorization|password|secret|token)(\s*[=:]\s*)([^,\s&]+)', '\1\2<redacted>', 'g')"


@query("n17_redacted_documents", f"SELECT doc_id, {_redacted_sql('text')} AS text FROM documents")
def n17(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "documents").select("doc_id", t.redacted(F.col("text")).alias("text"))


@query("n17_redacted_conversations", f"SELECT conv_id, turn, {_redacted_sql('text')} AS text FROM conversations")
def n17_conversations(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "conversations").select("conv_id", "turn", t.redacted(F.col("text")).alias("text"))

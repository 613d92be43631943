"""Stored tables: entries from files, appends, upserts, purges, backfills, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import clusters as c
from ..sources import entries as e
from ..sources import tables as s
from ..sources.versions import Table
from . import sql
from .normalize import image_of
from .quality import FEED_SQL, feeds
from .ranking import CLUSTERS
from .registry import query

_ENTRY_JSON = "id LONG, title STRING, url STRING, content STRING, feed STRUCT<id: LONG, title: STRING>, _corrupt_record STRING"


@query("s01_entries_from_json", sql.ENTRY + " SELECT id, title, url, feed_id FROM entry")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as JSON lines and read with a fixed schema; lines that don't fit would keep their text."""
    rows = e.entries(spark, d).select("id", "title", "url", "content", F.struct(F.col("feed_id").alias("id"), F.col("publisher").alias("title")).alias("feed"))
    path = s.new_path(spark, "entries")
    rows.write.json(path)
    read = spark.read.schema(_ENTRY_JSON).json(path)
    return read.filter("_corrupt_record IS NULL").select("id", "title", "url", F.col("feed.id").alias("feed_id"))


@query("s05_seed_feeds", f"WITH {FEED_SQL}, s AS (SELECT feed_id AS place, CASE WHEN feed_id % 3 = 0 THEN upper(feed_url) ELSE feed_url END AS url, CASE WHEN feed_id % 4 = 0 THEN 'urgent' ELSE direct_priority END AS priority, CASE WHEN feed_id % 2 = 0 THEN 'YES' ELSE 'n' END AS allow FROM feed UNION ALL SELECT feed_id + 1000000, feed_url, 'low', 'true' FROM feed WHERE feed_id % 5 = 0) SELECT lower(url) AS url_key, CASE WHEN priority IN ('high', 'normal', 'low') THEN priority ELSE 'normal' END AS priority, lower(allow) IN ('true', '1', 'yes', 'y') AS allow_service_content FROM s QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY place) = 1")
def s05(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("feed_id")
    rows = feeds(spark, d)
    first = rows.select(i.alias("place"), F.when(i % 3 == 0, F.upper("feed_url")).otherwise(F.col("feed_url")).alias("url"), F.when(i % 4 == 0, "urgent").otherwise(F.col("direct_priority")).alias("priority"), F.when(i % 2 == 0, "YES").otherwise("n").alias("allow"))
    again = rows.filter(i % 5 == 0).select((i + 1_000_000).alias("place"), F.col("feed_url").alias("url"), F.lit("low").alias("priority"), F.lit("true").alias("allow"))
    return seed_rows(first.unionByName(again))


def seed_rows(rows: DataFrame) -> DataFrame:
    """Seed feeds with valid settings; of addresses that differ in case the first one."""
    by = F.struct("place", "priority", "allow")
    rows = rows.filter(F.trim("url") != "").groupBy(F.lower("url").alias("url_key")).agg(F.min(by).alias("x"))
    priority = F.when(F.col("x.priority").isin("high", "normal", "low"), F.col("x.priority")).otherwise("normal")
    return rows.select("url_key", priority.alias("priority"), F.lower("x.allow").isin("true", "1", "yes", "y").alias("allow_service_content"))


@query("s06_article_append", sql.ARTICLE + " SELECT id, CAST(strftime(published_at, '%Y%m%d') AS INTEGER) AS day FROM article")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended to a table by day, the second one without what is stored."""
    rows, path = e.normalized(e.entries(spark, d)).drop("keyword_text"), s.new_path(spark, "articles")
    s.append_articles(e.first_by_url(rows.filter(F.col("id") < 500)), path)
    stored = spark.read.parquet(path).select("canonical_url").distinct()
    s.append_articles(e.first_by_url(rows.filter(F.col("id") >= 500)).join(stored, "canonical_url", "left_anti"), path)
    return spark.read.parquet(path).select("id", F.date_format("day", "yyyyMMdd").cast("int").alias("day"))


@query("s07_cluster_upsert", CLUSTERS + " SELECT cluster_id, CASE WHEN CAST(substr(cluster_id, 2) AS BIGINT) % 3 = 0 THEN n_sources ELSE 0 END AS n_sources FROM cluster")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt clusters put into a stored table, in the place of the old ones."""
    rows = c.clusters(c.linked(spark, d)).select("cluster_id", "n_sources")
    stored = Table(spark, s.new_path(spark, "clusters"), "cluster_id")
    stored.append(rows.select("cluster_id", F.lit(0).cast("long").alias("n_sources")))
    stored.upsert(rows.filter(F.substring("cluster_id", 2, 20).cast("long") % 3 == 0))
    return stored.read()


@query("s08_timeline_replace", sql.LINK + " SELECT cluster_id, article_id FROM link WHERE feed_id % 2 = 1 OR position <= 2")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """The timelines of touched clusters in a stored table, made anew."""
    links = c.linked(spark, d)
    stored = Table(spark, s.new_path(spark, "timeline"), "cluster_id")
    stored.append(links.select("cluster_id", "article_id"))
    touched = links.filter("feed_id % 2 = 0")
    stored.replace(touched.filter("position <= 2").select("cluster_id", "article_id"), touched)
    return stored.read()


@query("s09_purge", sql.ARTICLE + " SELECT id FROM article WHERE NOT (starts_with(canonical_url, 'https://m.') OR publisher = 'src9' OR starts_with(dedupe_hash, '0'))")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """Articles purged from a stored table by address, publisher and hash."""
    stored = Table(spark, s.new_path(spark, "articles"), "id")
    stored.append(e.articles(spark, d).select("id", "canonical_url", "publisher", "dedupe_hash"))
    stored.purge(F.col("canonical_url").startswith("https://m."), F.col("publisher") == "src9", F.col("dedupe_hash").startswith("0"))
    return stored.read().select("id")


@query("s10_sample_reset", sql.ARTICLE + f", sm AS (SELECT DISTINCT {sql.canonical('url')} AS u FROM entry WHERE id % 4 = 0) SELECT id FROM article WHERE canonical_url NOT IN (SELECT u FROM sm)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    sample = e.entries(spark, d).filter(F.col("id") % 4 == 0).select(urls.canonical(F.col("url")).alias("canonical_url")).distinct()
    return e.articles(spark, d).join(sample, "canonical_url", "left_anti").select("id")


@query("s11_orphan_prune", sql.LINK + ", cl AS (SELECT DISTINCT 'c' || CAST(user_id AS VARCHAR) AS cluster_id FROM events) SELECT cluster_id FROM cl WHERE cluster_id IN (SELECT cluster_id FROM link)")
def s11(spark: SparkSession, d: str) -> DataFrame:
    known = e.table(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster_id")).distinct()
    return known.join(c.linked(spark, d), "cluster_id", "left_semi")


@query("s14_run_metrics", "SELECT event_type AS metric, CASE WHEN event_type = 'click' THEN count(*)::DOUBLE ELSE round(list(value ORDER BY ts DESC, event_id DESC)[1], 6) END AS value FROM events GROUP BY event_type")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Counters add up, gauges keep their last value."""
    rows = e.table(spark, d, "events").select(F.col("event_type").alias("metric"), F.when(F.col("event_type") == "click", "counter").otherwise("gauge").alias("kind"), "value", F.struct("ts", "event_id").alias("at"))
    value = F.when(F.max("kind") == "counter", F.count("*").cast("double")).otherwise(F.round(F.max_by("value", "at"), 6))
    return rows.groupBy("metric").agg(value.alias("value"))


@query("n10_image_url", r"""WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://img.example.org/' || page_id || '.jpg#x' WHEN 1 THEN 'javascript:x' ELSE NULL END AS own, CASE WHEN page_id % 4 = 2 THEN 'https://img.example.org/t' || page_id || '.png' END AS thumb FROM pages)
SELECT page_id AS id, CASE WHEN starts_with(own, 'https') THEN split_part(own, '#', 1) WHEN thumb IS NOT NULL THEN thumb END AS image_url FROM m""")
def n10(spark: SparkSession, d: str) -> DataFrame:
    """Image candidates of entries made from the pages; the pages' own markup has none in the test data."""
    i, text = F.col("page_id"), F.lit(None).cast("string")
    own = F.when(i % 4 == 0, F.concat(F.lit("https://img.example.org/"), i.cast("string"), F.lit(".jpg#x"))).when(i % 4 == 1, "javascript:x")
    thumb = F.when(i % 4 == 2, F.array(F.struct(F.concat(F.lit("https://img.example.org/t"), i.cast("string"), F.lit(".png")).alias("url"))))
    none = {"media_content": "array<struct<url:string,type:string,medium:string>>", "links": "array<struct<rel:string,type:string,href:string>>", "enclosures": "array<struct<url:string,mime_type:string>>"}
    rows = e.table(spark, d, "pages").select(i.alias("id"), own.alias("image_url"), text.alias("lead_image_url"), text.alias("thumbnail_url"), thumb.alias("media_thumbnail"), *(F.lit(None).cast(t).alias(k) for k, t in none.items()), F.col("html").alias("content"))
    return image_of(rows)

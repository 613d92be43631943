"""Fetching, capping, balancing and deduplicating entries; ordered and limited lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clusters as c
from ..operators.ranks import ranked
from ..sources import entries as e
from . import sql
from .quality import JUDGED_SQL, FEED_SQL, feeds, judged
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
LAST = f"TIMESTAMP '{e.AS_OF}'"
CLUSTER_SQL = f""", cluster0 AS (SELECT cluster_id, count(*) AS n_sources, count(DISTINCT publisher) AS n_publishers, min(published_at) AS first_seen, max(published_at) AS last_updated,
  CAST((2 * CAST(sum(CAST(round(similarity_score * 10000) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000.0 AS score,
  list(title ORDER BY published_at DESC, article_id DESC)[1] AS headline, list(category ORDER BY published_at DESC, article_id DESC)[1] AS topic FROM link GROUP BY cluster_id),
cluster AS (SELECT *, CASE WHEN n_sources < {c.MIN_SOURCES} THEN 'hidden' WHEN epoch_us({LAST}) - epoch_us(last_updated) >= {c.STALE_HOURS} * 3600000000 THEN 'stale'
  WHEN n_sources < {c.EMERGING_SOURCES} AND epoch_us({LAST}) - epoch_us(last_updated) <= {c.EMERGING_HOURS} * 3600000000 THEN 'emerging' ELSE 'active' END AS status FROM cluster0)"""
CLUSTERS = sql.LINK + CLUSTER_SQL
FULL_CLUSTERS = sql.FULL_LINK + CLUSTER_SQL


def capped(rows: DataFrame, as_of: str, lookback_hours: int, per_feed: int, max_pages: int = 10) -> DataFrame:
    """The newest entries of each feed within its pages, not older than the lookback, ``per_feed`` at most."""
    page_size = max(1, min(per_feed, 100))
    newest = Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "id")
    rows = rows.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= max_pages * page_size)
    return rows.filter(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback_hours} HOURS")).filter(F.col("r") <= per_feed).drop("r")


@query("s02_fetch", sql.ENTRY + f", r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, id) AS r FROM entry) SELECT id, feed_id FROM r WHERE r <= 5 AND published_at >= {LAST} - INTERVAL 700 HOUR")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return capped(e.entries(spark, d), e.AS_OF, 700, 5).select("id", "feed_id")


@query("s03_active_feeds", f"WITH {FEED_SQL} SELECT feed_id FROM feed WHERE NOT disabled")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return feeds(spark, d).filter(~F.coalesce("disabled", F.lit(False))).select("feed_id")


@query("s04_merged_feed", sql.ENTRY + f", {FEED_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'own ' || publisher ELSE feed_title END AS title, feed_url FROM entry JOIN feed USING (feed_id)")
def s04(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), "publisher"))
    rows = e.entries(spark, d).join(feeds(spark, d), "feed_id", "left")
    return rows.select("id", F.coalesce(own, "feed_title").alias("title"), "feed_url")


@query("w01_balanced", sql.ENTRY + ", r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS r FROM entry), o AS (SELECT id, category, row_number() OVER (ORDER BY r, category) AS place FROM r) SELECT id, category, CAST(place AS INTEGER) AS place FROM o WHERE place <= 300")
def w01(spark: SparkSession, d: str) -> DataFrame:
    rows = e.entries(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("published_at"), "id"))).filter("r <= 300")
    top = rows.orderBy("r", "category").limit(300)  # the feature is a run's budget
    return top.select("id", "category", F.row_number().over(Window.orderBy("r", "category")).alias("place"))


@query("w02_newest", sql.ENTRY + " SELECT id FROM entry ORDER BY published_at DESC, id LIMIT 200")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return e.entries(spark, d).orderBy(F.desc("published_at"), "id").limit(200).select("id")


@query("w03_per_feed", sql.ENTRY + " SELECT id, feed_id FROM entry QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, id) <= 3")
def w03(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "id"))
    return e.entries(spark, d).withColumn("r", r).filter("r <= 3").select("id", "feed_id")


@query("w04_ingest_dedupe", JUDGED_SQL + ", stored AS (SELECT DISTINCT canonical_url FROM judged WHERE id % 50 = 7) SELECT id, canonical_url FROM judged WHERE NOT rejected AND canonical_url NOT IN (SELECT canonical_url FROM stored) QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY id) = 1")
def w04(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    stored = rows.filter(F.col("id") % 50 == 7).select("canonical_url").distinct()
    return e.first_by_url(rows.filter(~F.col("rejected"))).join(stored, "canonical_url", "left_anti").select("id", "canonical_url")


@query("a12_ingest_counters", JUDGED_SQL + ", u AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY id) AS r FROM judged WHERE NOT rejected) SELECT (SELECT count(*) FROM judged) AS seen, (SELECT count(*) FROM judged WHERE rejected) AS rejected, count(*) FILTER (r = 1) AS ingested, count(*) FILTER (r > 1) AS duplicates FROM u")
def a12(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    r = F.row_number().over(Window.partitionBy("canonical_url", "rejected").orderBy("id"))
    no, first = ~F.col("rejected"), F.col("r") == 1
    return rows.select("rejected", r.alias("r")).agg(F.count("*").alias("seen"), F.count_if("rejected").alias("rejected"), F.count_if(no & first).alias("ingested"), F.count_if(no & ~first).alias("duplicates"))


@query("w06_first_and_latest", sql.LINK + " SELECT cluster_id, list(article_id ORDER BY published_at, article_id)[1] AS first_id, list(article_id ORDER BY published_at DESC, article_id DESC)[1] AS latest_id FROM link GROUP BY cluster_id")
def w06(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("published_at", "article_id")
    return c.linked(spark, d).groupBy("cluster_id").agg(F.min_by("article_id", by).alias("first_id"), F.max_by("article_id", by).alias("latest_id"))


@query("w08_thumbnails", sql.LINK + ", i AS (SELECT cluster_id, article_id, published_at, similarity_score, split_part(url, '#', 1) AS image FROM link), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY cluster_id, lower(image) ORDER BY published_at DESC, similarity_score DESC, article_id DESC) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, similarity_score DESC, article_id DESC) AS r FROM f) SELECT cluster_id, string_agg(image, '|' ORDER BY r) AS images FROM r WHERE r <= 4 GROUP BY cluster_id")
def w08(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("published_at"), F.desc("similarity_score"), F.desc("article_id")]
    rows = c.linked(spark, d).select("cluster_id", "article_id", "published_at", "similarity_score", F.split_part("url", F.lit("#"), F.lit(1)).alias("image"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", F.lower("image")).orderBy(*order))).filter("k = 1")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).filter("r <= 4")
    return rows.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "image"))), lambda x: x["image"]), "|").alias("images"))


@query("w09_newest_sources", sql.LINK + " SELECT cluster_id, string_agg(CAST(article_id AS VARCHAR), '|' ORDER BY published_at DESC, article_id DESC) AS ids FROM link GROUP BY cluster_id")
def w09(spark: SparkSession, d: str) -> DataFrame:
    rows = c.linked(spark, d).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id")), asc=False).alias("s"))
    return rows.select("cluster_id", F.array_join(F.transform("s", lambda x: x["article_id"].cast("string")), "|").alias("ids"))


@query("w10_page_of_articles", sql.ARTICLE + " SELECT id, title FROM article ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 40")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).orderBy(F.desc("published_at"), F.desc("id")).offset(40).limit(20).select("id", "title")


_DEVELOPING = f"(status = 'emerging' OR (n_sources >= 2 AND epoch_us({LAST}) - epoch_us(last_updated) <= 24 * 3600000000))"


@query("w14_story_sorts", CLUSTERS + f" SELECT cluster_id, row_number() OVER (ORDER BY score DESC, last_updated DESC, cluster_id) AS top_rank, row_number() OVER (ORDER BY last_updated DESC, score DESC, cluster_id) AS latest_rank, row_number() OVER (ORDER BY {_DEVELOPING} DESC, last_updated DESC, score DESC, cluster_id) AS developing_rank FROM cluster WHERE status <> 'hidden'")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """All shown clusters by score, by time, and with the developing ones first."""
    rows = c.clusters(c.linked(spark, d)).filter("status <> 'hidden'").select("cluster_id", "score", "last_updated", "status", "n_sources")
    fresh = F.unix_micros(F.lit(e.AS_OF).cast("timestamp")) - F.unix_micros("last_updated") <= 24 * 3_600_000_000
    rows = rows.withColumn("is_developing", (F.col("status") == "emerging") | ((F.col("n_sources") >= 2) & fresh))
    score, updated, id_ = F.desc("score"), F.desc("last_updated"), F.asc("cluster_id")
    for name, order in (("top_rank", [score, updated, id_]), ("latest_rank", [updated, score, id_]), ("developing_rank", [F.desc("is_developing"), updated, score, id_])):
        rows = ranked(rows, order, name)
    return rows.select("cluster_id", "top_rank", "latest_rank", "developing_rank")


@query("w15_sections", CLUSTERS + ", t AS (SELECT cluster_id, row_number() OVER (ORDER BY score DESC, last_updated DESC, cluster_id) AS r FROM cluster WHERE status <> 'hidden'), dv AS (SELECT cluster_id, row_number() OVER (ORDER BY last_updated DESC, score DESC, cluster_id) AS r FROM cluster WHERE status <> 'hidden' AND cluster_id NOT IN (SELECT cluster_id FROM t WHERE r <= 4)) SELECT cluster_id, CASE WHEN r = 1 THEN 'lead' ELSE 'supporting' END AS section FROM t WHERE r <= 4 UNION ALL SELECT cluster_id, 'developing' FROM dv WHERE r <= 4")
def w15(spark: SparkSession, d: str) -> DataFrame:
    rows = c.clusters(c.linked(spark, d)).filter("status <> 'hidden'")
    top = rows.orderBy(F.desc("score"), F.desc("last_updated"), "cluster_id").limit(4)
    lead = top.orderBy(F.desc("score"), F.desc("last_updated"), "cluster_id").limit(1).select("cluster_id", F.lit("lead").alias("section"))
    supporting = top.join(lead, "cluster_id", "left_anti").select("cluster_id", F.lit("supporting").alias("section"))
    developing = rows.join(top, "cluster_id", "left_anti").orderBy(F.desc("last_updated"), F.desc("score"), "cluster_id").limit(4).select("cluster_id", F.lit("developing").alias("section"))
    return lead.unionByName(supporting).unionByName(developing)


@query("w12_recent_decisions", sql.LINK + ", r AS (SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id DESC) AS r FROM link) SELECT cluster_id, string_agg(CAST(article_id AS VARCHAR), '|' ORDER BY article_id DESC) AS ids FROM r WHERE r <= 8 GROUP BY cluster_id")
def w12(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("article_id")))
    rows = c.linked(spark, d).withColumn("r", r).filter("r <= 8").groupBy("cluster_id").agg(F.sort_array(F.collect_list("article_id"), asc=False).alias("ids"))
    return rows.select("cluster_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"))


@query("w13_frequent_reasons", JUDGED_SQL + " SELECT reason, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(id)) AS INTEGER) AS place FROM (SELECT id, unnest(reasons) AS reason FROM judged) GROUP BY reason")
def w13(spark: SparkSession, d: str) -> DataFrame:
    """Reasons by frequency, first seen first: one row for each of a handful."""
    counts = judged(spark, d).select("id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counts.select("reason", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


@query("r12_article_debug", JUDGED_SQL + " SELECT id, normalized_title, trust, content_class, rejected, array_to_string(reasons, '|') AS reasons, len(robust) AS n_entities FROM judged")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", "normalized_title", "trust", "content_class", "rejected", t.joined(F.col("reasons")).alias("reasons"), F.size("robust").cast("long").alias("n_entities"))

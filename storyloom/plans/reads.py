"""The lists and documents that readers are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import clusters as c
from ..sources import entries as e
from . import sql
from .enrichment import E3, FACTS_SQL, FOCUS_SQL, K1, K4, SUMMARY_SQL, summary
from .quality import FEED_SQL, JUDGED_SQL, feeds, judged
from .ranking import CLUSTER_SQL, CLUSTERS, FULL_CLUSTERS, LAST, STAMP
from .registry import query


@query("r01_articles_page", sql.ARTICLE + f" SELECT id, title, publisher, {sql.stamp('published_at')} AS published_at FROM article ORDER BY article.published_at DESC, id DESC LIMIT 50")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).orderBy(F.desc("published_at"), F.desc("id")).limit(50).select("id", "title", "publisher", F.date_format("published_at", STAMP).alias("published_at"))


@query("r02_public_clusters", CLUSTERS + f" SELECT cluster_id, headline, topic, status, n_sources, score, {sql.stamp('last_updated')} AS last_updated FROM cluster WHERE status <> 'hidden'")
def r02(spark: SparkSession, d: str) -> DataFrame:
    rows = c.clusters(c.linked(spark, d)).filter("status <> 'hidden'")
    return rows.select("cluster_id", "headline", "topic", "status", "n_sources", "score", F.date_format("last_updated", STAMP).alias("last_updated"))


def sections(rows: DataFrame, top_n: int = 6, developing_n: int = 8, just_n: int = 10) -> DataFrame:
    """(section, place, cluster_id): best scored, newest of the rest, and hidden or single-source ones."""

    def taken(pool: DataFrame, name: str, n: int, *order: Column) -> DataFrame:
        chosen = pool.orderBy(*order).limit(n)
        return chosen.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), "cluster_id")

    by_score, by_time = (F.desc("score"), F.desc("last_updated"), F.col("cluster_id")), (F.desc("last_updated"), F.desc("score"), F.col("cluster_id"))
    public = rows.filter((F.col("status") != "hidden") & (F.col("n_sources") >= 2))
    top = taken(public, "top", top_n, *by_score)
    developing = taken(public.join(top, "cluster_id", "left_anti"), "developing", developing_n, *by_time)
    rest = rows.filter((F.col("status") == "hidden") | (F.col("n_sources") < 2)).join(top, "cluster_id", "left_anti").join(developing, "cluster_id", "left_anti")
    return top.unionByName(developing).unionByName(taken(rest, "just_in", just_n, *by_time))


SECTION_SQL = """, t AS (SELECT 'top' AS section, CAST(row_number() OVER (ORDER BY score DESC, last_updated DESC, cluster_id) AS INTEGER) AS place, cluster_id FROM cluster WHERE status <> 'hidden' AND n_sources >= 2 QUALIFY place <= 6),
dv AS (SELECT 'developing' AS section, CAST(row_number() OVER (ORDER BY last_updated DESC, score DESC, cluster_id) AS INTEGER) AS place, cluster_id FROM cluster WHERE status <> 'hidden' AND n_sources >= 2 AND cluster_id NOT IN (SELECT cluster_id FROM t) QUALIFY place <= 8),
ji AS (SELECT 'just_in' AS section, CAST(row_number() OVER (ORDER BY last_updated DESC, score DESC, cluster_id) AS INTEGER) AS place, cluster_id FROM cluster WHERE (status = 'hidden' OR n_sources < 2) QUALIFY place <= 10),
sec AS (SELECT * FROM t UNION ALL SELECT * FROM dv UNION ALL SELECT * FROM ji)"""


@query("r03_homepage", CLUSTERS + SECTION_SQL + " SELECT * FROM sec")
def r03(spark: SparkSession, d: str) -> DataFrame:
    return sections(c.clusters(c.linked(spark, d)))


@query("u04_section_exclusion", CLUSTERS + SECTION_SQL + " SELECT cluster_id FROM cluster WHERE status <> 'hidden' AND cluster_id NOT IN (SELECT cluster_id FROM t)")
def u04(spark: SparkSession, d: str) -> DataFrame:
    rows = c.clusters(c.linked(spark, d))
    top = sections(rows).filter("section = 'top'")
    return rows.filter("status <> 'hidden'").join(top, "cluster_id", "left_anti").select("cluster_id")


@query("u05_section_union", CLUSTERS + SECTION_SQL + " SELECT section, count(*) AS n FROM sec GROUP BY section")
def u05(spark: SparkSession, d: str) -> DataFrame:
    return sections(c.clusters(c.linked(spark, d))).groupBy("section").agg(F.count("*").alias("n"))


def visibility(status: Column, n: Column) -> Column:
    return F.when(status != "hidden", "visible").when(n < 2, "single_source").otherwise("candidate")


@query("r04_r05_visibility", CLUSTERS + " SELECT cluster_id, status <> 'hidden' AS shown, CASE WHEN status <> 'hidden' THEN 'visible' WHEN n_sources < 2 THEN 'single_source' ELSE 'candidate' END AS visibility FROM cluster")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return c.clusters(c.linked(spark, d)).select("cluster_id", (F.col("status") != "hidden").alias("shown"), visibility(F.col("status"), F.col("n_sources")).alias("visibility"))


def stories(links: DataFrame, as_of: str = e.AS_OF) -> DataFrame:
    """A cluster as one nested document: newest sources first, thumbnails, flags."""
    nested = links.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id", "title", "publisher", "url", "similarity_score")), asc=False).alias("sources"))
    rows = c.clusters(links, as_of).join(nested, "cluster_id")
    fresh = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_updated") <= 24 * 3_600_000_000
    return rows.withColumn("is_developing", (F.col("status") == "emerging") | ((F.col("n_sources") >= 2) & fresh)).withColumn("is_single_source", F.col("n_sources") == 1)


@query("r06_story", CLUSTERS + f" SELECT cluster_id, n_sources, string_agg(l.url, '|' ORDER BY l.published_at DESC, l.article_id DESC) AS urls, any_value(status = 'emerging' OR (n_sources >= 2 AND epoch_us({LAST}) - epoch_us(last_updated) <= 86400000000)) AS is_developing, n_sources = 1 AS is_single_source FROM cluster JOIN link l USING (cluster_id) GROUP BY cluster_id, n_sources")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return stories(c.linked(spark, d)).select("cluster_id", "n_sources", F.array_join("sources.url", "|").alias("urls"), "is_developing", "is_single_source")


#: A window that reaches the test data's articles.
DAYS = 30
_ERRORS = "CASE WHEN feed_id % 19 = 0 THEN feed_id % 4 ELSE 0 END AS error_count, CASE WHEN feed_id % 38 = 0 THEN ' timeout ' ELSE '' END AS error_message, CASE WHEN feed_id % 4 <> 3 THEN 'Group ' || feed_id % 3 END AS group_title"


def monitored(spark: SparkSession, d: str) -> DataFrame:
    """The feeds with their errors, group and last check."""
    i = F.col("feed_id")
    checked = e.table(spark, d, "events").groupBy(F.col("user_id").alias("feed_id")).agg(F.max("ts").cast("timestamp").alias("checked_at"))
    return feeds(spark, d).join(checked, "feed_id").select(
        "*",
        F.when(i % 19 == 0, i % 4).otherwise(0).alias("error_count"),
        F.when(i % 38 == 0, " timeout ").otherwise("").alias("error_message"),
        F.when(i % 4 != 3, F.concat(F.lit("Group "), (i % 3).cast("string"))).alias("group_title"),
    )


def _key(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def recent_names(rows: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Articles since ``days`` before ``as_of`` by name: count, last time, and the name as the newest article has it."""
    rows = rows.filter(F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    title = F.trim(F.coalesce("feed_title", F.lit("")))
    name = F.when(title != "", title).otherwise(F.coalesce("publisher", F.lit("")))
    return rows.withColumn("name", name).filter("name <> ''").groupBy(_key("name").alias("key")).agg(F.count("*").alias("n"), F.max("fetched_at").alias("last_fetched_at"), F.max_by("name", F.struct("fetched_at", "id")).alias("name"))


def source_health(feeds: DataFrame, rows: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Each feed with its group, safe address, state, errors and recent articles (by its id, else by its title), by group and name."""
    by_feed = rows.filter(F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).groupBy("feed_id").agg(F.count("*").alias("by_feed"))
    by_name = recent_names(rows, as_of, days).select("key", F.col("n").alias("by_name"))
    message, n = F.trim(F.coalesce("error_message", F.lit(""))), F.coalesce("error_count", F.lit(0))
    failed = (message != "") | (n > 0)
    title = F.trim(F.coalesce("feed_title", F.lit("")))
    out = feeds.join(by_feed, "feed_id", "left").withColumn("key", _key("feed_title")).join(by_name, "key", "left").select(
        F.concat(F.lit("feed:"), F.col("feed_id").cast("string")).alias("id"),
        F.when(title == "", "Untitled feed").otherwise(title).alias("name"),
        urls.safe_feed_url(F.trim("feed_url")).alias("feed_url"),
        F.when(F.trim("group_title") != "", F.trim("group_title")).alias("group"),
        (~F.coalesce("disabled", F.lit(False))).alias("enabled"),
        F.col("checked_at").alias("last_fetched_at"),
        F.coalesce("by_feed", "by_name", F.lit(0)).alias("recent_article_count"),
        F.when(failed, "error").otherwise("ok").alias("error_status"),
        F.when(failed, F.when(message != "", message).otherwise(F.concat(n.cast("string"), F.lit(" recent parsing errors")))).alias("error_message"),
    )
    return out.orderBy(F.lower(F.coalesce("group", F.lit(""))), F.lower("name"), "id")


def publisher_health(rows: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """What is shown of sources where feeds aren't known: recent articles by name, the most first."""
    names = recent_names(rows, as_of, days).filter("NOT key IN ('', 'unknown')")
    return names.orderBy(F.desc("n"), "key").select(F.concat(F.lit("publisher:"), "key").alias("id"), "name", "last_fetched_at", F.col("n").alias("recent_article_count"))


@query("r11_source_health", sql.ARTICLE + f""", {FEED_SQL}, mon AS (SELECT *, {_ERRORS} FROM feed JOIN (SELECT user_id AS feed_id, max(ts) AS checked_at FROM events GROUP BY user_id) USING (feed_id)), s AS (SELECT feed_id, count(*) AS n FROM article WHERE published_at >= {LAST} - INTERVAL {DAYS} DAY GROUP BY feed_id)
SELECT 'feed:' || feed_id AS id, feed_title AS name, split_part(feed_url, '#', 1) AS feed_url, group_title AS group, NOT disabled AS enabled, {sql.stamp('checked_at')} AS last_fetched_at, coalesce(n, 0) AS recent_article_count,
  CASE WHEN error_count > 0 OR trim(error_message) <> '' THEN 'error' ELSE 'ok' END AS error_status, CASE WHEN trim(error_message) <> '' THEN trim(error_message) WHEN error_count > 0 THEN error_count || ' recent parsing errors' END AS error_message FROM mon LEFT JOIN s USING (feed_id)""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    known = feeds(spark, d).select("feed_id", "feed_title")
    rows = e.articles(spark, d).join(known, "feed_id", "left").withColumn("fetched_at", F.col("published_at"))
    return source_health(monitored(spark, d), rows, e.AS_OF, DAYS).withColumn("last_fetched_at", F.date_format("last_fetched_at", STAMP))


@query("r11_publisher_health", sql.ARTICLE + f" SELECT 'publisher:' || lower(trim(publisher)) AS id, list(publisher ORDER BY published_at DESC, id DESC)[1] AS name, {sql.stamp('max(published_at)')} AS last_fetched_at, count(*) AS recent_article_count FROM article WHERE published_at >= {LAST} - INTERVAL {DAYS} DAY GROUP BY lower(trim(publisher)) HAVING lower(trim(publisher)) NOT IN ('', 'unknown')")
def r11_publishers(spark: SparkSession, d: str) -> DataFrame:
    rows = e.articles(spark, d).withColumn("feed_title", F.lit(None).cast("string")).withColumn("fetched_at", F.col("published_at"))
    return publisher_health(rows, e.AS_OF, DAYS).withColumn("last_fetched_at", F.date_format("last_fetched_at", STAMP))


_REJECTED = {"articles_rejected_stale": "stale_content", "articles_rejected_service_finance": "affiliate_finance"}
_METRICS_SQL = (
    JUDGED_SQL
    + sql.LINK.removeprefix(sql.ARTICLE)
    + CLUSTER_SQL
    + f""", jm AS (SELECT count(*) AS articles_fetched_raw, count(DISTINCT feed_id) AS feeds_with_new_articles, count(*) FILTER (rejected) AS articles_rejected_quality, {", ".join(f"count(*) FILTER (rejected AND list_contains(reasons, '{r}')) AS {n}" for n, r in _REJECTED.items())} FROM judged),
am AS (SELECT count(*) AS latest_articles_stored, count(DISTINCT publisher) FILTER (publisher <> 'unknown') AS active_sources, epoch_us(max(published_at)) // 1000000 AS last_ingest_time FROM article),
fm AS (SELECT count(*) AS configured_feed_count, count(*) FILTER (NOT disabled) AS active_feed_count FROM feed),
cm AS (SELECT count(*) FILTER (status = 'hidden') AS clusters_hidden_total, count(*) FILTER (status <> 'hidden') AS clusters_active_total, CAST(coalesce(sum(n_sources), 0) AS BIGINT) AS n FROM cluster),
met AS (SELECT * EXCLUDE (n), articles_fetched_raw - latest_articles_stored AS latest_duplicate_articles_skipped, latest_articles_stored - n AS articles_pending_clustering FROM jm, am, fm, cm)"""
)


def metrics(judged_rows: DataFrame, articles: DataFrame, feeds: DataFrame, clusters: DataFrame) -> DataFrame:
    """(metric, value): what the latest run fetched, rejected and stored, and what is there now."""
    rejected = {n: F.count_if(F.col("rejected") & F.array_contains("reasons", r)) for n, r in _REJECTED.items()}
    run = judged_rows.agg(F.count("*").alias("articles_fetched_raw"), F.countDistinct("feed_id").alias("feeds_with_new_articles"), F.count_if("rejected").alias("articles_rejected_quality"), *(x.alias(n) for n, x in rejected.items()))
    known = F.when(F.col("publisher") != "unknown", F.col("publisher"))
    kept = articles.agg(F.count("*").alias("latest_articles_stored"), F.countDistinct(known).alias("active_sources"), F.unix_seconds(F.max("published_at")).alias("last_ingest_time"))
    configured = feeds.agg(F.count("*").alias("configured_feed_count"), F.count_if(~F.coalesce("disabled", F.lit(False))).alias("active_feed_count"))
    live = clusters.agg(F.count_if(F.col("status") == "hidden").alias("clusters_hidden_total"), F.count_if(F.col("status") != "hidden").alias("clusters_active_total"), F.coalesce(F.sum("n_sources"), F.lit(0)).alias("attached"))
    one = run.join(kept).join(configured).join(live)  # one row each
    one = one.withColumn("latest_duplicate_articles_skipped", F.col("articles_fetched_raw") - F.col("latest_articles_stored")).withColumn("articles_pending_clustering", F.col("latest_articles_stored") - F.col("attached")).drop("attached")
    return one.unpivot([], one.columns, "metric", "value")


@query("r14_metric_rows", _METRICS_SQL + " SELECT metric, value FROM (UNPIVOT met ON COLUMNS(*) INTO NAME metric VALUE value)")
def r14(spark: SparkSession, d: str) -> DataFrame:
    rows = e.articles(spark, d)
    return metrics(judged(spark, d), rows, feeds(spark, d), c.clusters(e.links(rows)))


@query("r15_pipeline_status", CLUSTERS + " SELECT count(*) FILTER (status <> 'hidden') AS visible, count(*) FILTER (status = 'hidden' AND n_sources >= 2) AS candidates, count(*) FILTER (n_sources = 1) AS single FROM cluster")
def r15(spark: SparkSession, d: str) -> DataFrame:
    return c.clusters(c.linked(spark, d)).agg(F.count_if(F.col("status") != "hidden").alias("visible"), F.count_if((F.col("status") == "hidden") & (F.col("n_sources") >= 2)).alias("candidates"), F.count_if(F.col("n_sources") == 1).alias("single"))


_AGE = f"(epoch_us({LAST}) - epoch_us(last_updated)) // 60000000"
#: Characters of a summary in the cluster list and on the homepage.
LIST_PREVIEW, HOME_PREVIEW = 160, 180


def preview(text: Column, most: int, cut: int) -> Column:
    """A trimmed text, or its first ``cut`` characters and dots where it is longer than ``most``."""
    text = F.trim(text)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(cut))), F.lit("...")))


def freshness(last_updated: Column, as_of: str) -> Column:
    """How long ago, in the largest whole unit; null without a time."""
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last_updated)) / 60_000_000)
    ago = lambda n, unit: F.concat(F.lit("Updated "), n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(age < 1, "Updated just now").when(age < 60, ago(age, "m")).when(age < 1440, ago(F.floor(age / 60), "h")).when(age.isNotNull(), ago(F.floor(age / 1440), "d"))


def _preview_sql(most: int, cut: int) -> str:
    return f"CASE WHEN length(trim(summary)) <= {most} THEN trim(summary) ELSE rtrim(substr(trim(summary), 1, {cut})) || '...' END"


@query("r16_list_rows", FULL_CLUSTERS + E3 + K4 + K1 + FOCUS_SQL + FACTS_SQL + SUMMARY_SQL + f""" SELECT cluster_id, headline, topic, n_sources AS source_count, {sql.stamp('first_seen')} AS first_seen, {sql.stamp('last_updated')} AS last_updated, score, {_preview_sql(LIST_PREVIEW, LIST_PREVIEW - 3)} AS summary_preview, {_preview_sql(HOME_PREVIEW, HOME_PREVIEW - 1)} AS home_preview,
CASE WHEN {_AGE} < 1 THEN 'Updated just now' WHEN {_AGE} < 60 THEN 'Updated ' || {_AGE} || 'm ago' WHEN {_AGE} < 1440 THEN 'Updated ' || ({_AGE} // 60) || 'h ago' ELSE 'Updated ' || ({_AGE} // 1440) || 'd ago' END AS freshness FROM cluster JOIN summ USING (cluster_id)""")
def r16(spark: SparkSession, d: str) -> DataFrame:
    links = c.linked_with_keywords(spark, d)
    rows = c.clusters(links).join(summary(links), "cluster_id")
    return rows.select(
        "cluster_id", "headline", "topic", F.col("n_sources").alias("source_count"), F.date_format("first_seen", STAMP).alias("first_seen"), F.date_format("last_updated", STAMP).alias("last_updated"), "score",
        preview(F.col("summary"), LIST_PREVIEW, LIST_PREVIEW - 3).alias("summary_preview"), preview(F.col("summary"), HOME_PREVIEW, HOME_PREVIEW - 1).alias("home_preview"), freshness(F.col("last_updated"), e.AS_OF).alias("freshness"),
    )


@query("r17_image_choice", sql.LINK + " SELECT cluster_id, list(CASE WHEN article_id % 3 = 0 THEN url END ORDER BY published_at DESC, article_id DESC) FILTER (article_id % 3 = 0)[1] AS image, count(*) - 1 AS updates FROM link GROUP BY cluster_id".replace("list(CASE WHEN article_id % 3 = 0 THEN url END ORDER BY published_at DESC, article_id DESC) FILTER (article_id % 3 = 0)[1]", "coalesce((list(url ORDER BY published_at DESC, article_id DESC) FILTER (article_id % 3 = 0))[1], 'none')"))
def r17(spark: SparkSession, d: str) -> DataFrame:
    image = F.max_by("url", F.when(F.col("article_id") % 3 == 0, F.struct("published_at", "article_id")))
    return c.linked(spark, d).groupBy("cluster_id").agg(F.coalesce(image, F.lit("none")).alias("image"), (F.count("*") - 1).alias("updates"))


@query("r18_story_lists", sql.LINK + " SELECT cluster_id, string_agg(title, '|' ORDER BY published_at DESC, article_id DESC) AS titles FROM link WHERE NOT starts_with(lower(trim(title)), 'pending ') GROUP BY cluster_id")
def r18(spark: SparkSession, d: str) -> DataFrame:
    nested = c.linked(spark, d).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id", "title")), asc=False).alias("s"))
    kept = F.filter("s", lambda x: ~F.lower(F.trim(x["title"])).startswith("pending "))
    return nested.select("cluster_id", F.array_join(F.transform(kept, lambda x: x["title"]), "|").alias("titles"))


@query("f09_story_filters", sql.LINK + " SELECT cluster_id, bool_or(publisher = 'src3') AS by_publisher, bool_or(url LIKE 'http%') AS image_ready FROM link WHERE category = 'click' GROUP BY cluster_id")
def f09(spark: SparkSession, d: str) -> DataFrame:
    nested = c.linked(spark, d).filter("category = 'click'").groupBy("cluster_id").agg(F.collect_list(F.struct("publisher", "url")).alias("s"))
    return nested.select("cluster_id", F.exists("s", lambda x: x["publisher"] == "src3").alias("by_publisher"), F.exists("s", lambda x: urls.is_image_url(x["url"])).alias("image_ready"))

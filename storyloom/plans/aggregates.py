"""Counts, means, modes and top terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clusters as c
from ..sources import entries as e
from . import sql
from .quality import JUDGED_SQL, feeds, FEED_SQL, judged
from .ranking import CLUSTERS, LAST, STAMP
from .registry import query

BLOCK = sql.listed(t.TERM_BLOCKLIST)
PLAIN = "trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g'))"
MEANINGFUL = f"({PLAIN} <> '' AND {PLAIN} NOT IN ({BLOCK}) AND length({PLAIN}) > 2 AND len(list_filter(string_split({PLAIN}, ' '), lambda p: p NOT IN ({BLOCK}) AND length(p) > 2)) > 0)"


def top_terms_sql(name: str, column: str, limit: int, least: int, meaningful: bool = True) -> str:
    """CTEs that end in ``name`` (cluster_id, terms)."""
    where = f"WHERE {MEANINGFUL}" if meaningful else ""
    return f""", {name}0 AS (SELECT DISTINCT cluster_id, article_id, trim(unnest({column})) AS term FROM link), {name}1 AS (SELECT cluster_id, term, count(*) AS n FROM {name}0 WHERE term <> '' GROUP BY ALL),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS r, max(n) OVER (PARTITION BY cluster_id) AS most FROM (SELECT * FROM {name}1 {where})),
{name} AS (SELECT cluster_id, list(term ORDER BY r) AS terms FROM {name}2 WHERE r <= {limit} AND (n >= {least} OR most < {least}) GROUP BY cluster_id)"""


@query("a01_totals", sql.ARTICLE + " SELECT (SELECT count(*) FROM article) AS articles, (SELECT count(*) FROM entry) AS entries")
def a01(spark: SparkSession, d: str) -> DataFrame:
    rows = e.normalized(e.entries(spark, d))
    return rows.agg(F.countDistinct("canonical_url").alias("articles"), F.count("*").alias("entries"))


@query("a02_publishers", sql.ARTICLE + " SELECT count(DISTINCT publisher) AS publishers FROM article WHERE publisher <> 'unknown'")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).filter("publisher <> 'unknown'").agg(F.countDistinct("publisher").alias("publishers"))


@query("a03_cluster_score", CLUSTERS + " SELECT cluster_id, score FROM cluster")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return c.linked(spark, d).groupBy("cluster_id").agg(c.exact_mean("similarity_score").alias("score"))


@query("a04_cluster_profile", sql.FULL_LINK + f", w AS (SELECT cluster_id, count(*) AS n, min(published_at) AS a, max(published_at) AS b FROM link GROUP BY cluster_id), kk AS (SELECT cluster_id, string_agg(term, '|' ORDER BY term) AS keywords FROM (SELECT DISTINCT cluster_id, unnest(keywords) AS term FROM link) GROUP BY cluster_id), x AS (SELECT cluster_id, string_agg(term, '|' ORDER BY term) AS entities FROM (SELECT DISTINCT cluster_id, unnest(entities) AS term FROM link) GROUP BY cluster_id) SELECT cluster_id, n, {sql.stamp('a')} AS first_seen, {sql.stamp('b')} AS last_updated, coalesce(keywords, '') AS keywords, coalesce(entities, '') AS entities FROM w LEFT JOIN kk USING (cluster_id) LEFT JOIN x USING (cluster_id)")
def a04(spark: SparkSession, d: str) -> DataFrame:
    links = c.linked_with_keywords(spark, d)
    counts = links.groupBy("cluster_id").agg(F.count("*").alias("n"), F.date_format(F.min("published_at"), STAMP).alias("first_seen"), F.date_format(F.max("published_at"), STAMP).alias("last_updated"))
    for name in ("keywords", "entities"):
        counts = counts.join(c.union_of_terms(links, name).select("cluster_id", t.joined(F.col("terms")).alias(name)), "cluster_id", "left").fillna("", [name])
    return counts


@query("a05_topic_mode", sql.LINK + ", m AS (SELECT cluster_id, category, count(*) AS n, min(position) AS p FROM link GROUP BY ALL) SELECT cluster_id, category AS topic FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, p, lower(category)) = 1")
def a05(spark: SparkSession, d: str) -> DataFrame:
    modes = c.linked(spark, d).groupBy("cluster_id", "category").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "p", F.lower("category")))
    return modes.withColumn("r", r).filter("r = 1").select("cluster_id", F.col("category").alias("topic"))


@query("a06_class_mode", JUDGED_SQL + ", m AS (SELECT 'c' || CAST(feed_id AS VARCHAR) AS cluster_id, content_class, count(*) AS n FROM judged GROUP BY ALL) SELECT cluster_id, content_class FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, content_class DESC) = 1")
def a06(spark: SparkSession, d: str) -> DataFrame:
    counts = judged(spark, d).groupBy(F.concat(F.lit("c"), F.col("feed_id").cast("string")).alias("cluster_id"), "content_class").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.max_by("content_class", F.struct("n", "content_class")).alias("content_class"))


@query("a07_top_terms", sql.FULL_LINK + top_terms_sql("tt", "keywords", 4, 2) + " SELECT cluster_id, array_to_string(terms, '|') AS terms FROM tt")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return c.top_terms(c.linked_with_keywords(spark, d), "keywords", 4, 2).select("cluster_id", t.joined(F.col("terms")).alias("terms"))


@query("a08_shared_terms", sql.FULL_LINK + top_terms_sql("tt", "entities", 5, 2, False) + " SELECT cluster_id, array_to_string(terms, '|') AS terms FROM tt")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return c.top_terms(c.linked_with_keywords(spark, d), "entities", 5, 2, meaningful=False).select("cluster_id", t.joined(F.col("terms")).alias("terms"))


@query("a09_source_stats", sql.ARTICLE + f" SELECT feed_id, count(*) AS n, {sql.stamp('max(published_at)')} AS last_fetched, list(publisher ORDER BY published_at DESC, id DESC)[1] AS display_name FROM article WHERE published_at >= {LAST} - INTERVAL 29 DAY GROUP BY feed_id")
def a09(spark: SparkSession, d: str) -> DataFrame:
    recent = e.articles(spark, d).filter(F.col("published_at") >= F.lit(e.AS_OF).cast("timestamp") - F.expr("INTERVAL 29 DAYS"))
    return recent.groupBy("feed_id").agg(F.count("*").alias("n"), F.date_format(F.max("published_at"), STAMP).alias("last_fetched"), F.max_by("publisher", F.struct("published_at", "id")).alias("display_name"))


# Places whose mixture in one story is worth a warning.
LOCATION_TERMS = ["gaza", "iran", "israel", "lebanon", "mali", "sahel", "syria", "ukraine", "yemen"]


@query("a14_location_diversity", sql.FULL_LINK + f", p AS (SELECT DISTINCT cluster_id, unnest(list_concat(keywords, string_split(lower(title), ' '))) AS w FROM link) SELECT cluster_id, count(*) FILTER (w IN ({sql.listed(LOCATION_TERMS)})) AS places, count(*) FILTER (w IN ({sql.listed(LOCATION_TERMS)})) >= 3 AS warned FROM p GROUP BY cluster_id")
def a14(spark: SparkSession, d: str) -> DataFrame:
    places = c.linked_with_keywords(spark, d).select("cluster_id", F.explode(F.concat("keywords", F.split(F.lower("title"), " "))).alias("w")).distinct()
    n = F.count_if(F.col("w").isin(LOCATION_TERMS))
    return places.groupBy("cluster_id").agg(n.alias("places"), (n >= 3).alias("warned"))


@query("a16_topics", sql.ARTICLE + " SELECT DISTINCT category AS topic FROM article")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).select(F.col("category").alias("topic")).distinct().orderBy("topic")


@query("a17_feed_counters", sql.ENTRY + f", {FEED_SQL}, s AS (SELECT feed_id, disabled, count(id) AS n FROM feed LEFT JOIN entry USING (feed_id) GROUP BY ALL) SELECT count(*) AS configured, count(*) FILTER (NOT disabled) AS active, count(*) FILTER (NOT disabled AND n > 0) AS with_new, CAST(sum(n) FILTER (NOT disabled) AS BIGINT) AS entries FROM s")
def a17(spark: SparkSession, d: str) -> DataFrame:
    n = e.entries(spark, d).groupBy("feed_id").agg(F.count("*").alias("n"))
    rows = feeds(spark, d).join(n, "feed_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    on = ~F.col("disabled")
    return rows.agg(F.count("*").alias("configured"), F.count_if(on).alias("active"), F.count_if(on & (F.col("n") > 0)).alias("with_new"), F.sum(F.when(on, F.col("n"))).alias("entries"))


@query("a18_orphans", sql.LINK + ", cl AS (SELECT DISTINCT 'c' || CAST(user_id AS VARCHAR) AS cluster_id FROM events) SELECT cluster_id FROM cl LEFT JOIN link USING (cluster_id) GROUP BY cluster_id HAVING count(article_id) = 0")
def a18(spark: SparkSession, d: str) -> DataFrame:
    known = e.table(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster_id")).distinct()
    return known.join(c.linked(spark, d).select("cluster_id"), "cluster_id", "left_anti")

"""Headlines, summaries and other texts of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clusters as c
from . import sql
from .aggregates import MEANINGFUL, top_terms_sql
from .registry import query

E3, K4, K1 = top_terms_sql("e3", "entities", 3, 2), top_terms_sql("k4", "keywords", 4, 2), top_terms_sql("k1", "keywords", 3, 1)
E5, K5 = top_terms_sql("e5", "entities", 5, 2), top_terms_sql("k5", "keywords", 5, 2)
FOCUS_SQL = ", focus AS (SELECT c.cluster_id, coalesce(e3.terms[1], k4.terms[1], k1.terms[1], 'a developing story') AS focus FROM (SELECT DISTINCT cluster_id FROM link) c LEFT JOIN e3 USING (cluster_id) LEFT JOIN k4 USING (cluster_id) LEFT JOIN k1 USING (cluster_id))"
FACTS_SQL = """, facts AS (SELECT cluster_id, count(*) AS n, list_sort(list(DISTINCT publisher)) AS publishers, (epoch_us(max(published_at)) - epoch_us(min(published_at))) // 3600000000 AS hours,
  list(publisher ORDER BY published_at, article_id)[1] AS first_publisher, list(publisher ORDER BY published_at DESC, article_id DESC)[1] AS last_publisher FROM link GROUP BY cluster_id)"""


def first_of(terms):
    return F.try_element_at(terms, F.lit(1))


def known(links: DataFrame) -> DataFrame:
    """What the texts tell of a cluster, a row each: counts, publishers, span, the terms of its first and latest article, its frequent terms and its focus.

    All texts are expressions over these columns, so that a query with several of them groups the links once.
    """
    by, terms = F.struct("published_at", "article_id"), F.concat("entities", "keywords")
    facts = links.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("publisher")).alias("publishers"),
        c.hours_between(F.min("published_at"), F.max("published_at")).alias("hours"),
        F.min_by("publisher", by).alias("first_publisher"),
        F.max_by("publisher", by).alias("last_publisher"),
        F.min_by(terms, by).alias("first_terms"),
        F.max_by(terms, by).alias("latest_terms"),
    )
    # A repeated entity, else a repeated keyword, else a keyword, else a fixed text.
    focus = F.coalesce(first_of(c.picked("top_entities", 3, 2)), first_of(c.picked("top_keywords", 3, 2)), first_of(c.picked("top_keywords", 3, 1)), F.lit("a developing story"))
    rows = facts.join(c.frequent_terms(links), "cluster_id", "left").withColumn("focus", focus)
    return rows.withColumn("e3", c.picked("top_entities", 3, 2)).withColumn("k4", c.picked("top_keywords", 4, 2))


def focus(links: DataFrame) -> DataFrame:
    """(cluster_id, focus)."""
    return known(links).select("cluster_id", "focus")


def representative(links: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """(cluster_id, title) of the article with most shared terms; ties by time and id. ``tops`` are the clusters' frequent terms, if they are there."""
    tops = tops if tops is not None else c.frequent_terms(links)
    rows = links.join(tops.select("cluster_id", c.picked("top_entities", 5, 2).alias("e5"), c.picked("top_keywords", 5, 2).alias("k5")), "cluster_id", "left")
    empty = F.array().cast("array<string>")
    hits = 2 * F.size(F.array_intersect("entities", F.coalesce("e5", empty))) + F.size(F.array_intersect("keywords", F.coalesce("k5", empty)))
    score = hits * 120 + F.least(F.length(F.trim("title")), F.lit(120))
    return rows.groupBy("cluster_id").agg(F.max_by("title", F.struct(score, "published_at", "article_id")).alias("title"))


REP_SQL = E5 + K5 + """, rep AS (SELECT l.cluster_id, list(title ORDER BY 120 * (2 * len(list_intersect(entities, coalesce(e5.terms, []))) + len(list_intersect(keywords, coalesce(k5.terms, [])))) + least(length(trim(title)), 120) DESC, published_at DESC, article_id DESC)[1] AS title
  FROM link l LEFT JOIN e5 USING (cluster_id) LEFT JOIN k5 USING (cluster_id) GROUP BY l.cluster_id)"""


@query("w05_representative", sql.FULL_LINK + REP_SQL + " SELECT cluster_id, title FROM rep")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return representative(c.linked_with_keywords(spark, d))


@query("e01_headline", sql.FULL_LINK + REP_SQL + E3 + K4 + K1 + FOCUS_SQL + f" SELECT cluster_id, CASE WHEN len(string_split(trim(title), ' ')) >= 3 AND {sql.plain_title('title')} NOT IN ('untitled article', 'update') THEN trim(title) ELSE 'Developing coverage around ' || focus || '.' END AS headline FROM rep JOIN focus USING (cluster_id)")
def e01(spark: SparkSession, d: str) -> DataFrame:
    return headline(c.linked_with_keywords(spark, d))


def is_headline(title: Column) -> Column:
    """Whether a title can stand for its cluster: three words, and not one of the texts for a missing title."""
    return (F.size(F.split(F.trim(title), " ")) >= 3) & ~t.plain_title(title).isin("untitled article", "update")


def headline(links: DataFrame) -> DataFrame:
    return representative(links).join(focus(links), "cluster_id").select("cluster_id", headline_text().alias("headline"))


def headline_text() -> Column:
    """Of the representative's title and the focus."""
    title = F.trim("title")
    return F.when(is_headline(title), title).otherwise(F.concat(F.lit("Developing coverage around "), "focus", F.lit(".")))


SUMMARY_SQL = ", bits AS (SELECT f.*, focus.focus, list_concat(coalesce(e3.terms, []), list_filter(coalesce(k4.terms, []), lambda x: NOT list_contains(coalesce(e3.terms, []), x))) AS bits FROM facts f JOIN focus USING (cluster_id) LEFT JOIN e3 USING (cluster_id) LEFT JOIN k4 USING (cluster_id)), summ AS (SELECT cluster_id, n || ' sources, including ' || array_to_string(list_slice(publishers, 1, 3), ', ') || ', are covering ' || CASE WHEN len(bits) > 0 THEN array_to_string(list_slice(bits, 1, 4), ', ') ELSE focus END || '. Reporting has evolved across a ' || hours || '-hour window.' AS summary FROM bits)"


@query("e02_summary", sql.FULL_LINK + E3 + K4 + K1 + FOCUS_SQL + FACTS_SQL + SUMMARY_SQL + " SELECT * FROM summ")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return summary(c.linked_with_keywords(spark, d))


def summary(links: DataFrame) -> DataFrame:
    return known(links).select("cluster_id", summary_text().alias("summary"))


def summary_text() -> Column:
    bits = F.concat("e3", F.filter("k4", lambda k: ~F.array_contains("e3", k)))
    covered = F.when(F.size(bits) > 0, F.array_join(F.slice(bits, 1, 4), ", ")).otherwise(F.col("focus"))
    return F.concat(F.col("n").cast("string"), F.lit(" sources, including "), F.array_join(F.slice("publishers", 1, 3), ", "), F.lit(", are covering "), covered, F.lit(". Reporting has evolved across a "), F.col("hours").cast("string"), F.lit("-hour window."))


CHANGED_SQL = f""", tm AS (SELECT cluster_id, list(list_concat(entities, keywords) ORDER BY published_at, article_id) AS t FROM link GROUP BY cluster_id),
nt AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY term) AS new_terms FROM (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY term) AS r FROM (SELECT DISTINCT cluster_id, t, unnest(t[len(t)]) AS term FROM tm) WHERE {MEANINGFUL} AND NOT list_contains(t[1], term)) WHERE r <= 3 GROUP BY cluster_id),
np2 AS (SELECT cluster_id, list_slice(list_filter(publishers, lambda x: x <> first_publisher), 1, 2) AS p FROM facts),
chg AS (SELECT f.cluster_id, CASE WHEN n = 1 THEN 'Initial reporting from ' || first_publisher || ' established early coverage focused on ' || focus || '.' ELSE 'Coverage moved from the initial report by ' || first_publisher || ' to broader updates from ' || CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE 'follow-up reporting' END || '. Recent articles introduced ' || coalesce(new_terms, 'additional confirmed details') || '.' END AS what_changed
FROM facts f JOIN focus USING (cluster_id) JOIN np2 USING (cluster_id) LEFT JOIN nt USING (cluster_id))"""


@query("e03_what_changed", sql.FULL_LINK + E3 + K4 + K1 + FOCUS_SQL + FACTS_SQL + CHANGED_SQL + " SELECT * FROM chg")
def e03(spark: SparkSession, d: str) -> DataFrame:
    return what_changed(c.linked_with_keywords(spark, d))


def what_changed(links: DataFrame) -> DataFrame:
    return known(links).select("cluster_id", changed_text().alias("what_changed"))


def changed_text() -> Column:
    new = F.slice(F.array_sort(F.filter(F.array_except("latest_terms", "first_terms"), t.is_meaningful)), 1, 3)
    others = F.slice(F.array_sort(F.array_except("publishers", F.array("first_publisher"))), 1, 2)
    one = F.concat(F.lit("Initial reporting from "), "first_publisher", F.lit(" established early coverage focused on "), "focus", F.lit("."))
    several = F.concat(
        F.lit("Coverage moved from the initial report by "), "first_publisher", F.lit(" to broader updates from "),
        F.when(F.size(others) > 0, F.array_join(others, ", ")).otherwise("follow-up reporting"),
        F.lit(". Recent articles introduced "), F.when(F.size(new) > 0, F.array_join(new, ", ")).otherwise("additional confirmed details"), F.lit("."),
    )
    return F.when(F.col("n") == 1, one).otherwise(several)


MATTERS_SQL = ", mat AS (SELECT cluster_id, 'This matters because ' || len(publishers) || ' publishers kept updating ' || focus || ' over ' || hours || ' hours, which indicates sustained relevance and continuing developments.' AS why_it_matters FROM facts JOIN focus USING (cluster_id))"


@query("e04_why_it_matters", sql.FULL_LINK + E3 + K4 + K1 + FOCUS_SQL + FACTS_SQL + MATTERS_SQL + " SELECT * FROM mat")
def e04(spark: SparkSession, d: str) -> DataFrame:
    return why_it_matters(c.linked_with_keywords(spark, d))


def why_it_matters(links: DataFrame) -> DataFrame:
    return known(links).select("cluster_id", matters_text().alias("why_it_matters"))


def matters_text() -> Column:
    return F.concat(F.lit("This matters because "), F.size("publishers").cast("string"), F.lit(" publishers kept updating "), "focus", F.lit(" over "), F.col("hours").cast("string"), F.lit(" hours, which indicates sustained relevance and continuing developments."))


@query("e05_key_facts", sql.FULL_LINK + E3 + K4 + FACTS_SQL + """, kf AS (SELECT f.*, coalesce(e3.terms, []) AS e, list_filter(coalesce(k4.terms, []), lambda x: NOT list_contains(coalesce(e3.terms, []), x)) AS k FROM facts f LEFT JOIN e3 USING (cluster_id) LEFT JOIN k4 USING (cluster_id))
SELECT cluster_id, array_to_string(list_slice(list_filter([n || CASE WHEN n = 1 THEN ' source' ELSE ' sources' END || ' are tracking this story, including ' || array_to_string(list_slice(publishers, 1, 3), ', ') || CASE WHEN len(publishers) > 3 THEN ', and ' || (len(publishers) - 3) || ' more' ELSE '' END || '.',
  CASE WHEN hours > 0 THEN 'Coverage spans about ' || hours || ' hours from first report to latest update.' ELSE 'Coverage is concentrated within the same reporting hour.' END,
  CASE WHEN len(e) > 0 THEN 'Repeated named entities include ' || array_to_string(e, ', ') || '.' END, CASE WHEN len(k) > 0 THEN 'Recurring themes include ' || array_to_string(list_slice(k, 1, 3), ', ') || '.' END,
  'Latest update came from ' || last_publisher || '.'], lambda x: x IS NOT NULL), 1, 5), '|') AS key_facts FROM kf""")
def e05(spark: SparkSession, d: str) -> DataFrame:
    return key_facts(c.linked_with_keywords(spark, d))


def key_facts(links: DataFrame) -> DataFrame:
    return known(links).select("cluster_id", key_facts_text().alias("key_facts"))


def key_facts_text() -> Column:
    k, n, p = F.filter("k4", lambda k: ~F.array_contains("e3", k)), F.col("n"), F.col("publishers")
    first = F.concat(n.cast("string"), F.when(n == 1, " source").otherwise(" sources"), F.lit(" are tracking this story, including "), F.array_join(F.slice(p, 1, 3), ", "), F.when(F.size(p) > 3, F.concat(F.lit(", and "), (F.size(p) - 3).cast("string"), F.lit(" more"))).otherwise(""), F.lit("."))
    span = F.when(F.col("hours") > 0, F.concat(F.lit("Coverage spans about "), F.col("hours").cast("string"), F.lit(" hours from first report to latest update."))).otherwise("Coverage is concentrated within the same reporting hour.")
    names = F.when(F.size("e3") > 0, F.concat(F.lit("Repeated named entities include "), F.array_join("e3", ", "), F.lit(".")))
    themes = F.when(F.size(k) > 0, F.concat(F.lit("Recurring themes include "), F.array_join(F.slice(k, 1, 3), ", "), F.lit(".")))
    latest = F.concat(F.lit("Latest update came from "), "last_publisher", F.lit("."))
    return t.joined(F.slice(F.array_compact(F.array(first, span, names, themes, latest)), 1, 5))


@query("e06_focus", sql.FULL_LINK + E3 + K4 + K1 + FOCUS_SQL + " SELECT cluster_id, focus FROM focus")
def e06(spark: SparkSession, d: str) -> DataFrame:
    return focus(c.linked_with_keywords(spark, d))

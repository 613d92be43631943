"""Search over clusters, their updates and their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clusters as c
from ..sources import entries as e
from ..sources.tables import stored
from . import sql
from .enrichment import CHANGED_SQL, E3, FACTS_SQL, FOCUS_SQL, K1, K4, MATTERS_SQL, SUMMARY_SQL, summary, what_changed, why_it_matters
from .ranking import FULL_CLUSTERS, STAMP
from .registry import query
from .stories import event_text, timeline

#: A search looks at the newest clusters that match, and shows its best results.
MOST_CLUSTERS, SHOWN = 200, 50
TERM = "the"
#: Terms that reach every field and rank of the test data.
TERMS = ["the", "an", "evolved", "reported", "click", "purchase", "because", "src3"]
# Ranks of results by the field that matched.
CLUSTER_RANKS = {"headline": 92, "topic": 88, "summary": 72, "article_title": 60}
UPDATE_RANKS = {"what_changed": 82, "why_it_matters": 78, "timeline": 66}
SOURCE_RANKS = {"publisher": 90, "title": 74, "topic": 64}
SAME_CLUSTER, SAME_PUBLISHER = 100, 96


def snippet(text: Column, term: Column, most: int = 220) -> Column:
    """The text around the first hit of a term in lower case, with dots where it is cut."""
    text = F.trim(text)
    at = F.position(term, F.lower(text)) - 1
    end = F.least(F.length(text), F.greatest(F.lit(0), at - most // 2) + most)
    start = F.greatest(F.lit(0), end - most)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substr(text, start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))
    none = F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(most - 3))), F.lit("..."))
    return F.when(F.length(text) <= most, text).when(at < 0, none).otherwise(cut)


def snippet_sql(text: str, term: str, most: int = 220) -> str:
    text = f"trim({text})"
    at = f"(instr(lower({text}), {term}) - 1)"
    end = f"least(length({text}), greatest(0, {at} - {most // 2}) + {most})"
    start = f"greatest(0, {end} - {most})"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN {at} < 0 THEN rtrim(substr({text}, 1, {most - 3})) || '...' ELSE CASE WHEN {start} > 0 THEN '...' ELSE '' END || trim(substr({text}, {start} + 1, {end} - {start})) || CASE WHEN {end} < length({text}) THEN '...' ELSE '' END END"


@query("r09_snippets", f"SELECT doc_id, {snippet_sql('text', chr(39) + 'licensed' + chr(39))} AS snippet FROM documents WHERE contains(lower(text), 'licensed')")
def r09(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "documents").filter(F.lower("text").contains("licensed")).select("doc_id", snippet(F.col("text"), F.lit("licensed")).alias("snippet"))


def searchable(links: DataFrame) -> DataFrame:
    """The visible clusters with all texts that a search looks at."""
    newest = links.groupBy("cluster_id").agg(F.max_by("publisher", F.struct("published_at", "article_id")).alias("source_name"))
    rows = c.clusters(links).filter("status <> 'hidden'").join(newest, "cluster_id")
    for part in (summary, what_changed, why_it_matters):
        rows = rows.join(part(links), "cluster_id")
    return rows


def first_field(hits: dict[str, Column]) -> Column:
    """The first field that has a hit, else null."""
    return F.coalesce(*(F.when(hit, F.lit(field)) for field, hit in hits.items()))


def rank_of(field: str, ranks: dict[str, int]) -> Column:
    return reduce(lambda rank, name: rank.when(F.col(field) == name, ranks[name]), ranks, F.when(F.lit(False), 0))


def search(stories: DataFrame, links: DataFrame, terms: list[str]) -> DataFrame:
    """All results for each of some terms in the newest :data:`MOST_CLUSTERS` of the visible clusters that match: at most one for a cluster, one for
    its updates, and one for each of its sources, with the first field that has the term, a rank and a snippet. A blank term has none.

    An update's field is ``timeline`` if only an event has the term: the first one that the collapsed timeline keeps. Titles
    count as one text with blanks between them; a term is found in one title or across two neighbours.
    """
    asked = sorted({term.strip().lower() for term in terms} - {""})
    term = F.explode(F.array(*map(F.lit, asked)).cast("array<string>")).alias("term")

    def hit(column: str | Column) -> Column:
        return F.coalesce(F.lower(column).contains(F.col("term")), F.lit(False))

    sources = links.select("cluster_id", "article_id", "title", "publisher", "url", "published_at", "category").join(stories.select("cluster_id"), "cluster_id", "left_semi")
    titles = F.col("title")
    if any(" " in x for x in asked):
        after = F.lead("title").over(Window.partitionBy("cluster_id").orderBy(F.desc("published_at"), F.desc("article_id")))
        titles = F.concat_ws(" ", titles, after)
    event = event_text(F.col("publisher"), F.col("title"))
    marks = sources.withColumn("titles", titles).select("*", term).groupBy("term", "cluster_id").agg(
        F.bool_or(hit("titles")).alias("in_titles"),
        F.bool_or(hit("title") | hit("publisher") | hit("category")).alias("in_sources"),
        F.bool_or(hit(event) | hit("title")).alias("in_events"),
    )
    texts = ("headline", "summary", "what_changed", "why_it_matters", "topic")
    some = reduce(lambda a, b: a | b, (hit(x) for x in texts)) | F.col("in_sources") | F.col("in_events")
    newest = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("last_updated"), "cluster_id"))
    found = stories.join(marks, "cluster_id").filter(some).withColumn("place", newest).filter(F.col("place") <= MOST_CLUSTERS)
    found = stored(found.drop("in_sources", "place"), "found")

    def results(rows: DataFrame, type_: str, suffix: Column, title: Column, shown: Column, rank: Column, at: Column, url: Column) -> DataFrame:
        id_ = F.concat(F.lit(f"{type_}:"), "cluster_id", F.lit(":"), suffix)
        return rows.select(
            "term", id_.alias("id"), F.lit(type_).alias("type"), "cluster_id", title.alias("title"), snippet(shown, F.col("term")).alias("snippet"), "topic",
            F.col("source_name"), F.col("n_sources").alias("source_count"), at.alias("last_updated"), url.alias("article_url"), F.col("field").alias("matched_field"), rank.alias("rank"), "score",
        )

    none = F.lit(None).cast("string")
    first_text = lambda *names: F.coalesce(*(F.when(hit(x) & (F.trim(x) != ""), F.col(x)) for x in names), F.col(names[0]))

    of_cluster = found.withColumn("field", first_field({x: hit(x) for x in ("headline", "topic", "summary")} | {"article_title": F.col("in_titles")})).filter("field IS NOT NULL")
    rank = F.when((F.lower("headline") == F.col("term")) | (F.lower("topic") == F.col("term")), SAME_CLUSTER).otherwise(rank_of("field", CLUSTER_RANKS))
    of_cluster = results(of_cluster, "cluster", F.lit("story"), F.col("headline"), first_text("summary", "headline", "topic"), rank, F.col("last_updated"), none)

    updates = found.withColumn("field", first_field({x: hit(x) for x in ("what_changed", "why_it_matters")}))
    of_text = results(updates.filter("field IS NOT NULL"), "update", F.col("field"), F.col("headline"), first_text("what_changed", "why_it_matters"), rank_of("field", UPDATE_RANKS), F.col("last_updated"), none)
    untold = updates.filter("field IS NULL AND in_events").withColumn("field", F.lit("timeline"))
    events = timeline(links.join(untold.select("cluster_id"), "cluster_id", "left_semi")).join(untold.select("term", "cluster_id"), "cluster_id").filter(hit("event") | hit("source_title"))
    events = events.groupBy("term", "cluster_id").agg(F.min_by(F.struct("event", "source_title", "at"), F.struct("at", "article_id")).alias("first"))
    untold = untold.join(events, ["term", "cluster_id"]).select("*", "first.event", "first.source_title", "first.at")
    of_event = results(untold, "update", F.col("field"), F.col("event"), first_text("event", "source_title"), rank_of("field", UPDATE_RANKS), F.col("at"), none)

    of_source = sources.join(found.drop("first_seen"), "cluster_id").withColumn("field", first_field({x: hit(x) for x in ("publisher", "title", "topic")})).filter("field IS NOT NULL").withColumn("source_name", F.col("publisher"))
    rank = F.when(F.lower("publisher") == F.col("term"), SAME_PUBLISHER).otherwise(rank_of("field", SOURCE_RANKS))
    shown = F.coalesce(F.when(hit("publisher"), F.col("publisher")), F.col("title"))
    of_source = results(of_source, "source", F.col("article_id").cast("string"), F.col("title"), shown, rank, F.col("last_updated"), F.col("url"))
    return of_cluster.unionByName(of_text).unionByName(of_event).unionByName(of_source)


def best_results(rows: DataFrame, limit: int = SHOWN) -> DataFrame:
    return rows.orderBy(F.desc("rank"), F.desc("score"), F.desc("last_updated"), "cluster_id", "id").limit(limit)


def _ranks(column: str, ranks: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in ranks.items()) + " END"


def search_sql(terms: list[str]) -> str:
    """All results (CTE ``res``). Of a publisher's events that have its name, the first one is always kept; these terms reach no others alone."""
    event = "publisher || ' reported: ' || title || '.'"
    return (
        FULL_CLUSTERS + E3 + K4 + K1 + FOCUS_SQL + FACTS_SQL + SUMMARY_SQL + CHANGED_SQL + MATTERS_SQL
        + f""", tm0 AS (SELECT unnest([{sql.listed(terms)}]) AS term), tls AS (SELECT cluster_id, string_agg(title, ' ' ORDER BY published_at DESC, article_id DESC) AS titles, list(publisher ORDER BY published_at DESC, article_id DESC)[1] AS source_name FROM link GROUP BY cluster_id),
src AS (SELECT term, cluster_id, article_id, title, publisher, url, published_at, {event} AS event, contains(lower(publisher), term) AS p, contains(lower(title), term) AS t, contains(lower(category), term) AS g, contains(lower({event}), term) AS e FROM link, tm0),
evs AS (SELECT term, cluster_id, list({{'event': event, 'title': title, 'at': published_at}} ORDER BY published_at, article_id)[1] AS first FROM src WHERE e OR t GROUP BY ALL),
sto AS (SELECT k.*, summary, what_changed, why_it_matters, titles, source_name, term, contains(lower(headline), term) AS h, contains(lower(topic), term) AS o, contains(lower(summary), term) AS s, contains(lower(titles), term) AS a, contains(lower(what_changed), term) AS w, contains(lower(why_it_matters), term) AS y
  FROM tm0, cluster k JOIN summ USING (cluster_id) JOIN chg USING (cluster_id) JOIN mat USING (cluster_id) JOIN tls USING (cluster_id) WHERE status <> 'hidden'),
mk AS (SELECT term, cluster_id, bool_or(p OR t OR g OR e) AS any_source FROM src GROUP BY ALL),
fd AS (SELECT sto.*, first FROM sto JOIN mk USING (term, cluster_id) LEFT JOIN evs USING (term, cluster_id) WHERE h OR o OR s OR w OR y OR any_source QUALIFY row_number() OVER (PARTITION BY term ORDER BY last_updated DESC, cluster_id) <= {MOST_CLUSTERS}),
res0 AS (SELECT term, 'cluster' AS type, cluster_id, 'story' AS suffix, headline AS title, CASE WHEN s THEN summary WHEN h THEN headline WHEN o THEN topic ELSE summary END AS shown, topic, source_name, n_sources AS source_count, last_updated, NULL AS article_url,
    CASE WHEN h THEN 'headline' WHEN o THEN 'topic' WHEN s THEN 'summary' ELSE 'article_title' END AS matched_field, CASE WHEN lower(headline) = term OR lower(topic) = term THEN {SAME_CLUSTER} ELSE {_ranks('matched_field', CLUSTER_RANKS)} END AS rank, score FROM fd WHERE h OR o OR s OR a
  UNION ALL SELECT term, 'update', cluster_id, NULL, CASE WHEN w OR y THEN headline ELSE first.event END, CASE WHEN w THEN what_changed WHEN y THEN why_it_matters WHEN contains(lower(first.event), term) THEN first.event ELSE first.title END, topic, source_name, n_sources, CASE WHEN w OR y THEN last_updated ELSE first.at END, NULL,
    CASE WHEN w THEN 'what_changed' WHEN y THEN 'why_it_matters' ELSE 'timeline' END AS matched_field, {_ranks('matched_field', UPDATE_RANKS)}, score FROM fd WHERE w OR y OR first IS NOT NULL
  UNION ALL SELECT term, 'source', cluster_id, CAST(article_id AS VARCHAR), src.title, CASE WHEN p THEN src.publisher ELSE src.title END, topic, src.publisher, n_sources, last_updated, src.url,
    CASE WHEN p THEN 'publisher' WHEN t THEN 'title' ELSE 'topic' END AS matched_field, CASE WHEN lower(src.publisher) = term THEN {SAME_PUBLISHER} ELSE {_ranks('matched_field', SOURCE_RANKS)} END, score FROM fd JOIN src USING (term, cluster_id) WHERE p OR t OR o),
res AS (SELECT type || ':' || cluster_id || ':' || coalesce(suffix, matched_field) AS id, {snippet_sql('shown', 'term')} AS snippet, CAST(rank AS INTEGER) AS rank, * EXCLUDE (suffix, shown, rank) FROM res0)"""
    )


@query("r07_search", search_sql([TERM]) + f" SELECT id, type, cluster_id, title, snippet, topic, source_name, source_count, {sql.stamp('res.last_updated')} AS last_updated, article_url, matched_field, rank FROM res ORDER BY rank DESC, score DESC, res.last_updated DESC, cluster_id, id LIMIT {SHOWN}")
def r07(spark: SparkSession, d: str) -> DataFrame:
    rows = best_results(search(stored(searchable(c.linked_with_keywords(spark, d)), "stories"), c.linked(spark, d), [TERM]))
    return rows.drop("score", "term").withColumn("last_updated", F.date_format("last_updated", STAMP))


@query("r08_rank_table", search_sql(TERMS) + " SELECT term, type, matched_field, rank, count(*) AS n FROM res GROUP BY ALL")
def r08(spark: SparkSession, d: str) -> DataFrame:
    rows = search(stored(searchable(c.linked_with_keywords(spark, d)), "stories"), c.linked(spark, d), TERMS)
    return rows.groupBy("term", "type", "matched_field", "rank").agg(F.count("*").alias("n"))


@query("r10_first_field", search_sql(["an"]) + " SELECT cluster_id, matched_field AS field FROM res WHERE type = 'cluster'")
def r10(spark: SparkSession, d: str) -> DataFrame:
    rows = search(stored(searchable(c.linked_with_keywords(spark, d)), "stories"), c.linked(spark, d), ["an"])
    return rows.filter("type = 'cluster'").select("cluster_id", F.col("matched_field").alias("field"))


@query("a15_search_counts", search_sql([TERM]) + " SELECT count(*) FILTER (type = 'cluster') AS clusters, count(*) FILTER (type = 'update') AS updates, count(*) FILTER (type = 'source') AS sources, count(*) AS total FROM res")
def a15(spark: SparkSession, d: str) -> DataFrame:
    rows = search(stored(searchable(c.linked_with_keywords(spark, d)), "stories"), c.linked(spark, d), [TERM])
    return rows.agg(F.count_if(F.col("type") == "cluster").alias("clusters"), F.count_if(F.col("type") == "update").alias("updates"), F.count_if(F.col("type") == "source").alias("sources"), F.count("*").alias("total"))

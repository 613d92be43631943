"""Features and evaluation of article-cluster pairs, topics, related clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as s
from ..functions import text as t
from ..functions.topics import THEMES, theme, theme_phrase, with_topics
from ..operators import clusters as c
from ..operators.related import best_by_blocks
from ..sources import entries as e
from ..sources.tables import stored
from . import sql
from .enrichment import E3, FOCUS_SQL, K1, K4, focus, is_headline
from .quality import judged
from .ranking import CLUSTERS, FULL_CLUSTERS
from .registry import query

STOP = sql.listed(s.CLUSTER_STOPWORDS + s.GENERIC_NEWS_TERMS)
BLOCK = sql.listed(s.ENTITY_BLOCKLIST)
PLACES = sql.listed(s.LOCATION_TERMS)


def tokens_sql(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '[\s/\-]+'), lambda w: w <> ''))"


def keywords_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({x}, lambda k: lower(trim(k))), lambda k: k <> '' AND k NOT IN ({STOP})))"


def entities_sql(x: str) -> str:
    return rf"list_distinct(list_filter(list_transform({x}, lambda k: lower(trim(k))), lambda k: k <> '' AND k NOT IN ({BLOCK}) AND len(list_filter(string_split_regex(k, '[\s/\-]+'), lambda p: p NOT IN ({BLOCK}))) > 0))"


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


def sorted_text(x):
    return t.joined(F.array_sort(x))


@query("c02_time_proximity", sql.LINK + ", p AS (SELECT *, first_value(published_at) OVER (PARTITION BY cluster_id ORDER BY position) AS seed FROM link) SELECT article_id, round(CASE WHEN abs(epoch_us(published_at) - epoch_us(seed)) / 3600000000.0 >= 72 THEN 0.0 ELSE 1.0 - abs(epoch_us(published_at) - epoch_us(seed)) / 3600000000.0 / 72 END, 6) AS proximity FROM p")
def c02(spark: SparkSession, d: str) -> DataFrame:
    seed = F.first("published_at").over(Window.partitionBy("cluster_id").orderBy("position"))
    return c.linked(spark, d).withColumn("seed", seed).select("article_id", F.round(s.time_proximity(F.col("published_at"), F.col("seed")), 6).alias("proximity"))


CLASSES = ["hard_news", "politics", "local_news", "business_news", "service_finance", "evergreen", "opinion", "sports", "entertainment", "official_release", "low_trust_aggregator", "unknown"]
_A, _B = "list_extract([" + sql.listed(CLASSES) + "], CAST(id % 12 + 1 AS INTEGER))", "list_extract([" + sql.listed(CLASSES) + "], CAST((id // 12) % 12 + 1 AS INTEGER))"
_HARD = sql.listed(s.HARD_NEWS)


@query("c05_class_mismatch", sql.ENTRY + f", p AS (SELECT id, {_A} AS a, {_B} AS b FROM entry), m AS (SELECT *, (a IN ('service_finance', 'evergreen') AND b IN ({_HARD})) OR (b IN ('service_finance', 'evergreen') AND a IN ({_HARD})) OR (a = 'opinion' AND b IN ('hard_news', 'politics', 'local_news')) OR (b = 'opinion' AND a IN ('hard_news', 'politics', 'local_news')) OR (a IN ('sports', 'entertainment') AND b IN ({_HARD})) OR (b IN ('sports', 'entertainment') AND a IN ({_HARD})) AS x FROM p) SELECT id, a <> 'unknown' AND b <> 'unknown' AND a <> b AND x AS mismatch FROM m")
def c05(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in CLASSES))
    a, b = F.element_at(names, (F.col("id") % 12 + 1).cast("int")), F.element_at(names, (F.floor(F.col("id") / 12) % 12 + 1).cast("int"))
    return e.entries(spark, d).select("id", s.class_mismatch(a, b).alias("mismatch"))


@query("c06_semantic_keywords", sql.KEYWORDS + f" SELECT id, {sorted_sql(keywords_sql('keywords'))} AS keywords FROM full_article")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return e.with_keywords(e.articles(spark, d)).select("id", sorted_text(s.semantic_keywords(F.col("keywords"))).alias("keywords"))


@query("c07_semantic_entities", sql.ARTICLE + f" SELECT id, {sorted_sql(entities_sql('entities'))} AS entities FROM article")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).select("id", sorted_text(s.semantic_entities(F.col("entities"))).alias("entities"))


@query("c08_primary_entities", sql.ARTICLE + f" SELECT id, {sorted_sql('list_filter(' + entities_sql('entities') + f', lambda x: contains(x, chr(32)) OR x IN ({PLACES}))')} AS entities FROM article")
def c08(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return e.articles(spark, d).select("id", sorted_text(s.primary_entities(F.col("entities"), none)).alias("entities"))


@query("c09_locations", sql.KEYWORDS + f" SELECT id, {sorted_sql('list_distinct(list_filter(list_concat(' + tokens_sql('title') + ', keywords), lambda x: x IN (' + PLACES + ')))')} AS places FROM full_article")
def c09(spark: SparkSession, d: str) -> DataFrame:
    rows = e.with_keywords(e.articles(spark, d))
    return rows.select("id", sorted_text(s.locations(F.col("title"), F.col("keywords"), F.array().cast("array<string>"))).alias("places"))


_TITLE_TOKENS = f"list_filter({tokens_sql('normalized_title')}, lambda x: length(x) > 3 AND x NOT IN ({STOP}))"


@query("c10_title_tokens", sql.ARTICLE + f" SELECT id, {sorted_sql(_TITLE_TOKENS)} AS tokens FROM article")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return e.articles(spark, d).select("id", sorted_text(s.title_tokens(F.col("normalized_title"))).alias("tokens"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """One row of features for each article, with the topic of its text."""
    rows = judged(spark, d, e.with_keywords(e.articles(spark, d)))
    return features_of(with_topics(rows.withColumn("stored_topic", F.lit(None).cast("string"))))


def features_of(rows: DataFrame) -> DataFrame:
    """Features of judged articles (plans/quality.py). What a cluster's headline would be made of its title alone is kept as headline_title and headline_tokens."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("raw_keywords", F.col("keywords")).withColumn("raw_entities", F.col("entities"))
    rows = rows.withColumn("keywords", s.semantic_keywords(F.col("keywords"))).withColumn("own_entities", s.semantic_entities(F.col("entities")))
    rows = rows.withColumn("primary", s.primary_entities(F.col("entities"), F.coalesce("primary_entities", none)))
    rows = rows.withColumn("entities", F.array_union("own_entities", F.transform("primary_entities", F.lower)))
    good = is_headline(F.col("title"))
    made = s.title_tokens(F.array_join(F.concat(F.array(F.lit("developing coverage around")), "raw_keywords", "raw_entities"), " "))
    return rows.select(
        F.col("id").alias("article_id"), F.col("published_at").alias("at"), F.col("normalized_title").alias("title"), F.col("title").alias("display"), "raw_keywords", "raw_entities", "keywords", "entities", "own_entities", "primary",
        s.locations(F.col("title"), F.col("keywords"), F.col("entities")).alias("places"), s.title_tokens(F.col("normalized_title")).alias("title_tokens"),
        s.in_title(F.col("primary"), F.col("title")).alias("title_entities"), "topic", F.array_compact(F.array(F.nullif(F.lower(F.trim("publisher")), F.lit("")))).alias("publishers"), "content_class", "reasons", "trust",
        F.when(good, F.col("normalized_title")).otherwise("developing coverage around").alias("headline_title"), F.when(good, s.title_tokens(F.col("normalized_title"))).otherwise(made).alias("headline_tokens"),
    )


@query("c11_title_entities")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("article_id", t.joined(F.col("title_entities")).alias("title_entities"))


@query("c12_article_features")
def c12(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).drop("headline_title", "headline_tokens")


def cluster_features(members: DataFrame) -> DataFrame:
    """One row of features for each cluster_id of ``members`` (features of its articles): the headline of its representative and what it
    names, unions of terms, the most frequent topic and class, and the latest time."""
    return features_maker()(members)


def features_maker() -> Callable[[DataFrame], DataFrame]:
    """:func:`cluster_features` for many tables: its expressions are written once.

    Articles are brought together by cluster once. Their classes, topics and terms are counted by one aggregate; what is most frequent among them
    tells the representative, as ``enrichment.headline`` has it.
    """

    def as_items(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))

    def terms(column: str) -> Column:
        return F.filter(F.array_distinct(F.transform(column, F.trim)), lambda x: (x != "") & t.is_meaningful(x))

    def of(kind: str, value: Column) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, value))

    none = F.array().cast("array<string>")
    item = F.explode(F.concat(*(F.coalesce(as_items(k, x), as_items(k, none)) for k, x in (("entity", terms("raw_entities")), ("keyword", terms("raw_keywords")), ("class", F.array("content_class")), ("topic", F.array("topic")))))).alias("item")
    items = ["cluster_id", F.struct("at", "article_id").alias("by"), item]
    n, x = F.col("n"), F.col("x")
    modes = [
        F.array_sort(of("entity", F.struct((-n).alias("n"), x))).alias("top_entities"),
        F.array_sort(of("keyword", F.struct((-n).alias("n"), x))).alias("top_keywords"),
        F.max(F.when(F.col("kind") == "class", F.struct("n", "x")))["x"].alias("content_class_"),
        F.min(F.when(F.col("kind") == "topic", F.struct((-n).alias("n"), "first", "x")))["x"].alias("topic_"),
    ]

    def frequent(top: str) -> Column:
        """The first five terms: those of two articles at least, or any if there are none."""
        return F.filter(F.slice(top, 1, 5), lambda x: (x["n"] <= -2) | (F.col(top)[0]["n"] > -2))["x"]

    hits = 2 * F.size(F.array_intersect("raw_entities", frequent("top_entities"))) + F.size(F.array_intersect("raw_keywords", frequent("top_keywords")))
    order = F.struct(hits * 120 + F.least(F.length(F.trim("display")), F.lit(120)), "at", "article_id")
    lists = {"keywords": "keywords", "entities": "own_entities", "primary": "primary", "publishers": "publishers"}
    made = [
        F.max("at").alias("at_"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))).alias(f"{k}_") for k, v in lists.items()),
        *(F.first(k).alias(k) for k in ("content_class_", "topic_")), F.trim(F.max_by("display", order)).alias("headline"),
        F.first(F.coalesce(F.get("top_entities", F.lit(0))["x"], F.get("top_keywords", F.lit(0))["x"], F.lit("a developing story"))).alias("focus"),
    ]
    headline_ = F.when(is_headline(F.col("headline")), F.col("headline")).otherwise(F.concat(F.lit("Developing coverage around "), "focus", F.lit("."))).alias("headline")
    kept = ["cluster_id", "at_", *(f"{k}_" for k in lists), "content_class_", "topic_", headline_]
    title = t.plain_title(F.col("headline")).alias("title_")
    last = [s.title_tokens(F.col("title_")).alias("title_tokens_"), s.in_title(F.col("primary_"), F.col("headline")).alias("title_entities_"), s.locations(F.col("headline"), F.col("keywords_"), F.col("entities_")).alias("places_")]

    def make(members: DataFrame) -> DataFrame:
        members = members.repartition("cluster_id")
        counts = members.select(*items).groupBy("cluster_id", "item.kind", "item.x").agg(F.count("*").alias("n"), F.min("by").alias("first"))
        whole = members.join(counts.groupBy("cluster_id").agg(*modes), "cluster_id").groupBy("cluster_id").agg(*made)
        return whole.select(*kept).select("*", title).select("*", *last)

    return make


_MADE = "CASE id % 6 WHEN 0 THEN title || ' war in iran' WHEN 1 THEN title || ' epstein records' WHEN 2 THEN 'Trump administration ' || title WHEN 3 THEN title || ' votes' WHEN 4 THEN title || ' deal' ELSE title END"


def _made(spark: SparkSession, d: str) -> DataFrame:
    i, title = F.col("id") % 6, F.col("title")
    made = F.when(i == 0, F.concat(title, F.lit(" war in iran"))).when(i == 1, F.concat(title, F.lit(" epstein records"))).when(i == 2, F.concat(F.lit("Trump administration "), title)).when(i == 3, F.concat(title, F.lit(" votes"))).when(i == 4, F.concat(title, F.lit(" deal"))).otherwise(title)
    return e.entries(spark, d).select("id", t.words(made).alias("w"))


_WORDS = f"regexp_extract_all(lower({_MADE}), '[a-z0-9]+')"
_THEME = "CASE " + " ".join(f"WHEN list_has_any(w, [{sql.listed(m)}]) THEN '{n}'" for n, m in THEMES) + " ELSE '' END"


@query("t02_theme", sql.ENTRY + f", w AS (SELECT id, {_WORDS} AS w FROM entry) SELECT id, {_THEME} AS theme FROM w")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("id", theme(F.col("w")).alias("theme"))


@query("t03_theme_phrase", sql.ENTRY + f", w AS (SELECT id, {_WORDS} AS w FROM entry), h AS (SELECT *, {_THEME} AS theme FROM w) SELECT id, CASE WHEN theme = 'War' AND list_contains(w, 'iran') THEN 'Iran War' WHEN theme = 'War' AND list_contains(w, 'ukraine') THEN 'Ukraine War' WHEN theme = 'War' AND list_contains(w, 'israel') THEN 'Israel War' WHEN theme = 'Files' AND list_contains(w, 'epstein') THEN 'Epstein Files' WHEN theme = 'Admin' AND list_contains(w, 'trump') THEN 'Trump Admin' ELSE theme END AS phrase FROM h")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("id", theme_phrase(theme(F.col("w")), F.col("w")).alias("phrase"))


@query("t09_topic_match", CLUSTERS + f", p AS (SELECT cluster_id, regexp_extract_all(lower(headline), '[a-z0-9]+') AS a, regexp_extract_all(lower(lag(headline) OVER (PARTITION BY topic ORDER BY cluster_id)), '[a-z0-9]+') AS b FROM cluster) SELECT cluster_id, array_to_string(a, ' ') = array_to_string(b, ' ') OR len(list_filter(list_intersect(a, b), lambda x: x NOT IN ({sql.listed(s.TOPIC_BLOCKLIST)}))) > 0 AS matches FROM p WHERE b IS NOT NULL")
def t09(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("headline").over(Window.partitionBy("topic").orderBy("cluster_id"))
    rows = c.clusters(c.linked(spark, d)).withColumn("before", before).filter("before IS NOT NULL")
    return rows.select("cluster_id", s.topics_match(t.words(F.col("headline")), t.words(F.col("before"))).alias("matches"))


def related(clusters: DataFrame, limit: int = 4) -> DataFrame:
    """(cluster_id, place, related_id): clusters that share topics, entities or two keywords, by 4 * topic + 3 * entities + keywords.

    ``clusters`` has cluster_id, last_updated, topic, entities and keywords.
    """
    by = Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.desc("entity"), F.desc("keyword"), F.desc("last_updated"), F.desc("related_id"))
    pairs = best_by_blocks(stored(clusters, "clusters"), limit)
    return pairs.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit).select("cluster_id", "place", "related_id", "score")


_REL = """, ck AS (SELECT cluster_id, list_distinct(flatten(list(kws))) AS keywords, list_distinct(flatten(list(ents))) AS entities FROM (SELECT cluster_id, {k} AS kws, {n} AS ents FROM link) GROUP BY cluster_id),
rc AS (SELECT k.cluster_id, k.last_updated, list_filter(regexp_extract_all(lower(focus), '[a-z0-9]+'), lambda x: x NOT IN ({b})) AS topics, entities, keywords FROM cluster k JOIN focus USING (cluster_id) JOIN ck USING (cluster_id) WHERE status <> 'hidden'),
rp AS (SELECT a.cluster_id, b.cluster_id AS related_id, b.last_updated, CAST(len(list_intersect(a.topics, b.topics)) > 0 AS BIGINT) AS topic, len(list_intersect(a.entities, b.entities)) AS entity, len(list_intersect(a.keywords, b.keywords)) AS keyword FROM rc a JOIN rc b ON a.cluster_id <> b.cluster_id),
rs AS (SELECT *, 4 * topic + 3 * entity + keyword AS score FROM rp WHERE topic = 1 OR entity >= 1 OR keyword >= 2)"""


@query("c22_related", FULL_CLUSTERS + E3 + K4 + K1 + FOCUS_SQL + _REL.replace("{k}", keywords_sql("keywords")).replace("{n}", entities_sql("entities")).replace("{b}", sql.listed(s.TOPIC_BLOCKLIST)) + " SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, entity DESC, keyword DESC, last_updated DESC, related_id DESC) AS INTEGER) AS place, related_id, score FROM rs QUALIFY place <= 4")
def c22(spark: SparkSession, d: str) -> DataFrame:
    return related(_related_input(spark, d))


def _related_input(spark: SparkSession, d: str) -> DataFrame:
    links = c.linked_with_keywords(spark, d)
    terms = links.groupBy("cluster_id").agg(*(F.array_distinct(F.flatten(F.collect_set(f(F.col(x))))).alias(x) for x, f in (("keywords", s.semantic_keywords), ("entities", s.semantic_entities))))
    topics = F.filter(t.words(F.col("focus")), lambda x: ~x.isin(s.TOPIC_BLOCKLIST))
    rows = c.clusters(links).filter("status <> 'hidden'").select("cluster_id", "last_updated").join(focus(links), "cluster_id").join(terms, "cluster_id")
    return rows.select("cluster_id", "last_updated", topics.alias("topics"), "entities", "keywords")


@query("w11_most_related", FULL_CLUSTERS + E3 + K4 + K1 + FOCUS_SQL + _REL.replace("{k}", keywords_sql("keywords")).replace("{n}", entities_sql("entities")).replace("{b}", sql.listed(s.TOPIC_BLOCKLIST)) + " SELECT cluster_id, list(related_id ORDER BY score DESC, entity DESC, keyword DESC, last_updated DESC, related_id DESC)[1] AS related_id FROM rs GROUP BY cluster_id")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return related(_related_input(spark, d), 1).select("cluster_id", "related_id")


def best_candidates(pairs: DataFrame, tie: float = s.TIE) -> DataFrame:
    """(article_id, best): of the candidates that pass the gate, the one that an ordered walk ends with."""
    return best_maker(tie)(pairs)


def best_maker(tie: float = s.TIE) -> Callable[[DataFrame], DataFrame]:
    """:func:`best_candidates` for many tables: its expressions are written once."""
    walk = walker(tie)
    return lambda pairs: walk(pairs.filter("gate"))


def walked(pairs: DataFrame, tie: float = s.TIE) -> DataFrame:
    """(article_id, best): the candidate that an ordered walk over all of them ends with.

    Candidates come newest first. One takes the lead if its score is higher by more than ``tie``, or as good within
    it with more shared entities, keywords, a later time or a larger id. That isn't transitive, so it is a fold and no maximum.
    """
    return walker(tie)(pairs)


def walker(tie: float) -> Callable[[DataFrame], DataFrame]:
    one = F.struct(F.col("at_").alias("at"), "candidate", "score", "entity_overlap", "keyword_overlap", "attach")
    ordered = F.sort_array(F.collect_list(one), asc=False).alias("c")

    def rank(x):
        return F.struct(x["entity_overlap"], x["keyword_overlap"], x["at"], x["candidate"])

    def better(best, x):
        ahead = (x["score"] > best["score"] + tie) | ((best["score"] <= x["score"] + tie) & (rank(x) > rank(best)))
        return F.when(ahead, x).otherwise(best)

    last = F.aggregate(F.slice("c", 2, F.size("c")), F.col("c")[0], better).alias("best")
    return lambda pairs: pairs.groupBy("article_id").agg(ordered).select("article_id", last)


@query("j13_related_lookup", FULL_CLUSTERS + E3 + K4 + K1 + FOCUS_SQL + _REL.replace("{k}", keywords_sql("keywords")).replace("{n}", entities_sql("entities")).replace("{b}", sql.listed(s.TOPIC_BLOCKLIST)) + ", tp AS (SELECT cluster_id, related_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, entity DESC, keyword DESC, last_updated DESC, related_id DESC) AS place FROM rs QUALIFY place <= 4) SELECT tp.cluster_id, CAST(place AS INTEGER) AS place, headline FROM tp JOIN cluster k ON k.cluster_id = related_id")
def j13(spark: SparkSession, d: str) -> DataFrame:
    headlines = c.clusters(c.linked(spark, d)).select(F.col("cluster_id").alias("related_id"), "headline")
    return related(_related_input(spark, d)).join(headlines, "related_id").select("cluster_id", "place", "headline")

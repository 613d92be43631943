"""Quality gates: source controls, trust, classes, staleness, text flags, feed addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as t
from ..functions import urls
from ..sources import entries as e
from . import sql
from .registry import query


def matches(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


def contains(column: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in tokens) + ")"


#: A feed for each id, with made-up settings that cover all cases.
FEED_SQL = """feed AS (SELECT DISTINCT user_id AS feed_id, 'Feed ' || user_id || CASE WHEN user_id % 11 = 0 THEN ' Reuters' WHEN user_id % 13 = 0 THEN ' Google News' ELSE '' END AS feed_title,
  'https://' || CASE WHEN user_id % 17 = 0 THEN 'news.google.com' ELSE 'feeds.example.org' END || '/f' || user_id || '?utm_source=x' AS feed_url,
  CASE WHEN user_id % 7 = 0 THEN 'high' WHEN user_id % 7 = 1 THEN 'low' ELSE 'normal' END AS direct_priority, user_id % 10 = 0 AS direct_allow, user_id % 9 <> 0 AS direct_promote, user_id % 6 = 5 AS disabled FROM events),
seed AS (SELECT 'https://feeds.example.org/f' || feed_id AS seed_url, CASE WHEN feed_id % 4 = 0 THEN 'high' ELSE 'normal' END AS seed_priority, feed_id % 5 = 0 AS seed_allow, feed_id % 8 <> 0 AS seed_promote, 'Category ' || feed_id % 3 AS seed_category FROM feed WHERE feed_id % 2 = 0)"""


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of the test events."""
    i = F.col("feed_id")
    rows = e.table(spark, d, "events").select(F.col("user_id").alias("feed_id")).distinct()
    host = F.when(i % 17 == 0, "news.google.com").otherwise("feeds.example.org")
    return rows.select(
        i,
        F.concat(F.lit("Feed "), i.cast("string"), F.when(i % 11 == 0, " Reuters").when(i % 13 == 0, " Google News").otherwise("")).alias("feed_title"),
        F.concat(F.lit("https://"), host, F.lit("/f"), i.cast("string"), F.lit("?utm_source=x")).alias("feed_url"),
        F.when(i % 7 == 0, "high").when(i % 7 == 1, "low").otherwise("normal").alias("direct_priority"),
        (i % 10 == 0).alias("direct_allow"),
        (i % 9 != 0).alias("direct_promote"),
        (i % 6 == 5).alias("disabled"),
    )


def seeds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("feed_id")
    return feeds(spark, d).filter(i % 2 == 0).select(F.concat(F.lit("https://feeds.example.org/f"), i.cast("string")).alias("seed_url"), F.when(i % 4 == 0, "high").otherwise("normal").alias("seed_priority"), (i % 5 == 0).alias("seed_allow"), (i % 8 != 0).alias("seed_promote"), F.concat(F.lit("Category "), (i % 3).cast("string")).alias("seed_category"))


def controls(feed: DataFrame, seed: DataFrame) -> DataFrame:
    """Each feed's controls: its own, and those of the seed row with its address."""
    seed = seed.withColumn("key", urls.url_key(F.col("seed_url")))
    both = feed.withColumn("key", urls.url_key(F.col("feed_url"))).join(seed, "key", "left")
    return both.select(
        "feed_id", "feed_title", "feed_url", "disabled",
        F.when(F.col("direct_priority") != "normal", F.col("direct_priority")).otherwise(F.coalesce("seed_priority", F.lit("normal"))).alias("priority"),
        (F.col("direct_allow") | F.coalesce("seed_allow", F.lit(False))).alias("allow_service_content"),
        (F.col("direct_promote") & F.coalesce("seed_promote", F.lit(True))).alias("promote_to_home"),
        F.coalesce("seed_category", F.lit("")).alias("feed_category"),
    )


CONTROL_SQL = FEED_SQL + f""", control AS (SELECT feed_id, feed_title, feed_url, disabled, CASE WHEN direct_priority <> 'normal' THEN direct_priority ELSE coalesce(seed_priority, 'normal') END AS priority,
  direct_allow OR coalesce(seed_allow, false) AS allow_service_content, direct_promote AND coalesce(seed_promote, true) AS promote_to_home, coalesce(seed_category, '') AS feed_category
  FROM feed LEFT JOIN seed ON lower({sql.canonical('feed_url')}) = lower({sql.canonical('seed_url')}))"""
_TRUST_SQL = f"CASE WHEN feed_url LIKE 'https://news.google.com/%' OR {matches('source_text', q.AGGREGATOR_PATTERNS)} OR priority = 'low' THEN 'low' WHEN priority = 'high' OR {matches('source_text', q.WIRE_PATTERNS)} THEN 'high' ELSE 'normal' END"


@query("q01_source_controls", f"WITH {CONTROL_SQL} SELECT feed_id, priority, allow_service_content, promote_to_home, feed_category FROM control")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return controls(feeds(spark, d), seeds(spark, d)).select("feed_id", "priority", "allow_service_content", "promote_to_home", "feed_category")


@query("j10_seed_lookup", f"WITH {FEED_SQL} SELECT feed_id, seed_priority, seed_category FROM feed JOIN seed ON lower({sql.canonical('feed_url')}) = lower({sql.canonical('seed_url')})")
def j10(spark: SparkSession, d: str) -> DataFrame:
    seed = seeds(spark, d).withColumn("key", urls.url_key(F.col("seed_url")))
    return feeds(spark, d).withColumn("key", urls.url_key(F.col("feed_url"))).join(seed, "key").select("feed_id", "seed_priority", "seed_category")


@query("q02_source_trust", f"WITH {CONTROL_SQL}, s AS (SELECT *, feed_title || ' ' || feed_url || ' ' || feed_category AS source_text FROM control) SELECT feed_id, {_TRUST_SQL} AS trust FROM s")
def q02(spark: SparkSession, d: str) -> DataFrame:
    rows = controls(feeds(spark, d), seeds(spark, d)).withColumn("source_text", F.concat_ws(" ", "feed_title", "feed_url", "feed_category"))
    return rows.select("feed_id", q.trust(F.col("source_text"), F.col("feed_url"), F.col("priority")).alias("trust"))


def controlled(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """``rows`` with their feeds' controls."""
    return rows.join(controls(feeds(spark, d), seeds(spark, d)), "feed_id")


def judged(spark: SparkSession, d: str, rows: DataFrame | None = None, as_of: str = e.AS_OF) -> DataFrame:
    """Normalised entries with their source's controls, trust, class, reasons and whether they are rejected.

    Of the tables in ``d``, controls are joined to the entries' places, so that texts aren't dealt out by feeds.
    """
    rows = rows if rows is not None else e.normalized(e.with_texts(controlled(spark, d, e.places(spark, d)), spark, d))
    rows = rows if "feed_title" in rows.columns else controlled(spark, d, rows)
    rows = rows.withColumn("quality_text", F.concat_ws(" ", "title", "url", "publisher", "feed_title", "feed_url", F.substring("content", 1, 1000)))
    rows = rows.withColumn("trust", q.trust(F.concat_ws(" ", "publisher", "feed_title", "feed_url", "feed_category"), F.col("feed_url"), F.col("priority")))
    rows = rows.withColumn("robust", q.robust_entities(F.concat_ws(" ", "title", F.substring("content", 1, 1000))))
    finance, service = F.col("has_finance"), F.col("has_service")  # asked once for the class and the reasons
    rows = rows.withColumn("has_finance", q.any_of(F.col("quality_text"), q.FINANCE_PATTERNS)).withColumn("has_service", q.any_of(F.col("quality_text"), q.SERVICE_PATTERNS))
    rows = rows.withColumn("primary_entities", F.slice("robust", 1, 6)).withColumn("content_class", q.content_class(F.col("quality_text"), F.col("trust"), F.col("primary_entities"), finance, service))
    rows = rows.withColumn("reasons", q.reasons(F.col("quality_text"), F.col("title"), F.col("trust"), as_of, finance, service)).drop("has_finance", "has_service")
    return rows.withColumn("rejected", q.rejected(F.col("reasons"), F.col("allow_service_content")))


_ROBUST = rf"""regexp_extract_all(' ' || regexp_replace(x, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ', '[^\p{{L}}\p{{N}}_]([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{1,3}})[^\p{{L}}\p{{N}}_]', 1)"""
_KNOWN = "[" + ", ".join(f"CASE WHEN regexp_matches(x, '(?i)\\b{n}\\b') THEN '{n}' END" for n in q.PUBLIC_FIGURES + q.LOCATIONS) + "]"
_GENERIC = f"(g = '' OR g IN ({sql.listed(q.GENERIC_ENTITIES)}) OR len(list_filter(string_split(g, ' '), lambda p: NOT (p IN ({sql.listed(q.GENERIC_ENTITIES)}) OR length(p) <= 2))) = 0)"
ROBUST_SQL = rf"""rx AS (SELECT id, title || ' ' || substr(content, 1, 1000) AS x FROM normal),
rl AS (SELECT id, list_concat(list_filter({_KNOWN}, lambda k: k IS NOT NULL), {_ROBUST}) AS l FROM rx),
ru AS (SELECT id, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS name, generate_subscripts(l, 1) AS i FROM rl),
rg AS (SELECT id, name, i, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS g FROM ru),
rd AS (SELECT id, name, i FROM rg WHERE NOT {_GENERIC} QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY i) = 1),
robust AS (SELECT id, list(name ORDER BY i) AS robust FROM rd GROUP BY id)"""
_CLASS = "CASE WHEN trust = 'low' THEN 'low_trust_aggregator' WHEN " + matches("quality_text", q.FINANCE_PATTERNS) + " THEN 'service_finance' WHEN " + matches("quality_text", q.SERVICE_PATTERNS) + " THEN 'evergreen' " + " ".join(f"WHEN {contains('lower(quality_text)', tokens)} THEN '{name}'" for name, tokens in q.CLASS_TOKENS) + f" WHEN len(primary_entities) > 0 OR {contains('lower(quality_text)', q.HARD_NEWS_TOKENS)} THEN 'hard_news' ELSE 'unknown' END"
_YEAR, _MONTH = int(e.AS_OF[:4]), int(e.AS_OF[5:7])


def stale_sql(title: str) -> str:
    parts = [rf"len(list_filter(regexp_extract_all(lower({title}), '\b(20[0-9]{{2}})\b', 1), lambda y: CAST(y AS INTEGER) < {_YEAR})) > 0"]
    for k, name in enumerate(q.MONTHS, 1):
        dated = rf"regexp_extract(lower({title}), '\b{name}\s+(20[0-9]{{2}})\b', 1)"
        early = "true" if k < _MONTH else "false"
        parts.append(rf"CASE WHEN {dated} <> '' THEN TRY_CAST({dated} AS INTEGER) < {_YEAR} OR (TRY_CAST({dated} AS INTEGER) = {_YEAR} AND {early}) ELSE {early} AND regexp_matches(lower({title}), '\b(?:of|in)\s+{name}\b|\b{name}\s+\d{{1,2}}\b') END")
    return "(" + " OR ".join(parts) + ")"


JUDGED_SQL = (
    sql.ARTICLE
    + ", "
    + CONTROL_SQL
    + ", "
    + ROBUST_SQL
    + f""", j0 AS (SELECT n.*, c.* EXCLUDE (feed_id), title || ' ' || url || ' ' || publisher || ' ' || feed_title || ' ' || feed_url || ' ' || substr(content, 1, 1000) AS quality_text,
  publisher || ' ' || feed_title || ' ' || feed_url || ' ' || feed_category AS source_text, coalesce(r.robust, []) AS robust FROM normal n JOIN control c USING (feed_id) LEFT JOIN robust r USING (id)),
j1 AS (SELECT *, {_TRUST_SQL} AS trust, list_slice(robust, 1, 6) AS primary_entities FROM j0),
j2 AS (SELECT *, {_CLASS} AS content_class, list_filter([CASE WHEN {stale_sql('title')} THEN 'stale_content' END, CASE WHEN {matches('quality_text', q.FINANCE_PATTERNS)} THEN 'affiliate_finance' END,
  CASE WHEN {matches('quality_text', q.SERVICE_PATTERNS)} THEN 'service_journalism' END, CASE WHEN trust = 'low' THEN 'low_trust_aggregator' END], lambda r: r IS NOT NULL) AS reasons FROM j1),
judged AS (SELECT *, list_has_any(reasons, ['stale_content', 'affiliate_finance', 'service_journalism']) AND NOT allow_service_content AS rejected FROM j2)"""
)


@query("q03_finance_service", f"SELECT doc_id, {matches('text', q.FINANCE_PATTERNS)} AS is_finance FROM documents")
def q03(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "documents").select("doc_id", q.any_of(F.col("text"), q.FINANCE_PATTERNS).alias("is_finance"))


@query("q04_service_journalism", f"SELECT doc_id, {matches('text', q.SERVICE_PATTERNS)} AS is_service FROM documents")
def q04(spark: SparkSession, d: str) -> DataFrame:
    return e.table(spark, d, "documents").select("doc_id", q.any_of(F.col("text"), q.SERVICE_PATTERNS).alias("is_service"))


@query("q05_stale_title", sql.ENTRY + f", y AS (SELECT id, title || CASE WHEN id % 5 = 0 THEN ' of March 2023' WHEN id % 5 = 1 THEN ' January 12' WHEN id % 5 = 2 THEN ' in June' ELSE '' END AS title FROM entry) SELECT id, {stale_sql('title')} AS is_stale FROM y")
def q05(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    title = F.concat("title", F.when(i % 5 == 0, " of March 2023").when(i % 5 == 1, " January 12").when(i % 5 == 2, " in June").otherwise(""))
    return e.entries(spark, d).select("id", q.is_stale(title, e.AS_OF).alias("is_stale"))


@query("q06_content_class", JUDGED_SQL + " SELECT id, trust, content_class FROM judged")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", "trust", "content_class")


@query("q07_robust_entities", JUDGED_SQL + " SELECT id, array_to_string(list_slice(robust, 1, 6), '|') AS primary_entities, array_to_string(list_slice(robust, 7, 14), '|') AS secondary_entities FROM judged")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", t.joined(F.slice("robust", 1, 6)).alias("primary_entities"), t.joined(F.slice("robust", 7, 8)).alias("secondary_entities"))


@query("q08_quality_decision", JUDGED_SQL + " SELECT id, CASE WHEN rejected THEN 'reject' ELSE 'accept' END AS action, array_to_string(reasons, '|') AS reasons FROM judged")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", F.when(F.col("rejected"), "reject").otherwise("accept").alias("action"), t.joined(F.col("reasons")).alias("reasons"))


WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def placeholder_sql(column: str) -> str:
    w = f"array_to_string({WORDS_SQL.format(column)}, ' ')"
    return f"({w} = '' OR {contains(w, t.PLACEHOLDERS)})"


def repetitive_sql(column: str, least: int = 6, ratio: float = 0.45) -> str:
    w = WORDS_SQL.format(column)
    return f"(len({w}) >= {least} AND len(list_distinct({w}))::DOUBLE / len({w}) < {ratio})"


@query("q09_text_flags", f"SELECT doc_id, trim(coalesce(text, '')) = '' AS is_blank, len({WORDS_SQL.format('text')}) < 8 AS is_short, {placeholder_sql('text')} AS is_placeholder, {repetitive_sql('text')} AS is_repetitive FROM documents")
def q09(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return e.table(spark, d, "documents").select("doc_id", (F.trim(F.coalesce(text, F.lit(""))) == "").alias("is_blank"), (F.size(t.words(text)) < 8).alias("is_short"), t.is_placeholder(text).alias("is_placeholder"), t.is_repetitive(text).alias("is_repetitive"))


@query("q11_reader_labels", f"SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN len({WORDS_SQL.format('text')}) < 8 THEN 'very short' WHEN {repetitive_sql('text', 8, 0.5)} THEN 'repetitive' ELSE 'ok' END AS label FROM conversations")
def q11(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    label = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank").when(F.size(t.words(text)) < 8, "very short").when(t.is_repetitive(text, 8, 0.5), "repetitive").otherwise("ok")
    return e.table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"))


@query("f01_lookback", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{e.AS_OF}' - INTERVAL 168 HOUR")
def f01(spark: SparkSession, d: str) -> DataFrame:
    rows = e.table(spark, d, "events")
    limit = F.lit(e.AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 168 HOURS")
    return rows.filter(F.col("ts") >= limit).select("event_id")


@query("f02_malformed", sql.ENTRY + ", b AS (SELECT id, CASE WHEN id % 9 = 0 THEN ' ' ELSE url END AS url, CASE WHEN id % 10 = 0 THEN 'soon' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS t FROM entry) SELECT id, CASE WHEN trim(url) = '' THEN 'blank address' WHEN TRY_CAST(t AS TIMESTAMP) IS NULL THEN 'bad time' END AS error FROM b WHERE trim(url) = '' OR TRY_CAST(t AS TIMESTAMP) IS NULL")
def f02(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = e.entries(spark, d).select("id", F.when(i % 9 == 0, " ").otherwise(F.col("url")).alias("url"), F.when(i % 10 == 0, "soon").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("at"))
    error = F.when(F.trim("url") == "", "blank address").when(F.col("at").try_cast("timestamp").isNull(), "bad time")
    return rows.select("id", error.alias("error")).filter(F.col("error").isNotNull())


@query("f03_reject_counters", JUDGED_SQL + " SELECT count(*) FILTER (rejected) AS rejected, count(*) FILTER (rejected AND list_contains(reasons, 'stale_content')) AS stale, count(*) FILTER (rejected AND list_contains(reasons, 'affiliate_finance')) AS finance, count(*) FILTER (NOT rejected) AS accepted FROM judged")
def f03(spark: SparkSession, d: str) -> DataFrame:
    r, reasons = F.col("rejected"), F.col("reasons")
    return judged(spark, d).agg(F.count_if(r).alias("rejected"), F.count_if(r & F.array_contains(reasons, "stale_content")).alias("stale"), F.count_if(r & F.array_contains(reasons, "affiliate_finance")).alias("finance"), F.count_if(~r).alias("accepted"))


@query("f04_annotated", JUDGED_SQL + " SELECT id, content_class, trust, array_to_string(reasons, '|') AS reasons, array_to_string(primary_entities, '|') AS primary_entities FROM judged WHERE NOT rejected")
def f04(spark: SparkSession, d: str) -> DataFrame:
    # A filter would be asked before, with patterns of its own: as the one element of an array, what is known of an entry is made once.
    quality = F.array(F.struct("rejected", "content_class", "trust", "reasons", "primary_entities"))
    rows = judged(spark, d).select("id", F.explode(F.filter(quality, lambda x: ~x["rejected"])).alias("quality"))
    return rows.select("id", "quality.content_class", "quality.trust", t.joined(F.col("quality.reasons")).alias("reasons"), t.joined(F.col("quality.primary_entities")).alias("primary_entities"))


_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_MADE = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://localhost/x' WHEN 1 THEN 'https://10.1.2.3/feed' WHEN 2 THEN 'https://8.8.8.8/feed#a' WHEN 3 THEN 'https://user:pw@example.org/f' WHEN 4 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=abc' WHEN 5 THEN 'ftp://example.org/f' ELSE url END AS url FROM pages"


def _made(spark: SparkSession, d: str) -> DataFrame:
    i, url = F.col("page_id") % 9, F.col("url")
    made = F.when(i == 0, "http://localhost/x").when(i == 1, "https://10.1.2.3/feed").when(i == 2, "https://8.8.8.8/feed#a").when(i == 3, "https://user:pw@example.org/f").when(i == 4, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("token=abc"))).when(i == 5, "ftp://example.org/f").otherwise(url)
    return e.table(spark, d, "pages").select("page_id", made.alias("url"))


_PUBLIC = r"""(h <> '' AND h <> 'localhost' AND NOT ends_with(h, '.localhost') AND NOT (regexp_full_match(h, '\d{1,3}(\.\d{1,3}){3}') AND (split_part(h, '.', 1)::INT IN (0, 10, 127) OR split_part(h, '.', 1)::INT >= 224
  OR (split_part(h, '.', 1)::INT = 169 AND split_part(h, '.', 2)::INT = 254) OR (split_part(h, '.', 1)::INT = 172 AND split_part(h, '.', 2)::INT BETWEEN 16 AND 31) OR (split_part(h, '.', 1)::INT = 192 AND split_part(h, '.', 2)::INT = 168))))"""


@query("f05_public_host", f"WITH m AS ({_MADE}), h AS (SELECT page_id, {_HOST.format('url')} AS h FROM m) SELECT page_id, {_PUBLIC.replace('split_part(h', 'TRY_CAST(split_part(h').replace('1)::INT', '1) AS INT)').replace('2)::INT', '2) AS INT)')} AS is_public FROM h")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("page_id", urls.is_public_host(urls.host_of(F.col("url"))).alias("is_public"))


_KEYS = "list_transform(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(split_part(url, '#', 1), '^[^?]*\\?', '') ELSE '' END, '&'), lambda p: lower(split_part(p, '=', 1)))"


@query("f06_safe_feed_url", f"WITH m AS ({_MADE}), h AS (SELECT page_id, url, {_HOST.format('url')} AS h FROM m) SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') AND NOT regexp_matches(url, '^[^:]+://[^/?#]*@') AND {_PUBLIC.replace('split_part(h', 'TRY_CAST(split_part(h').replace('1)::INT', '1) AS INT)').replace('2)::INT', '2) AS INT)')} AND NOT list_has_any({_KEYS}, [{sql.listed(urls.SECRET_KEYS)}]) THEN split_part(url, '#', 1) END AS safe_url FROM h")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("page_id", urls.safe_feed_url(F.col("url")).alias("safe_url"))


@query("f07_literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('The_') ) OR contains(lower(text), 'licensed under')")
def f07(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("text")
    return e.table(spark, d, "documents").filter(text.contains("the_") | text.contains("licensed under")).select("doc_id")


@query("f08_reader_text", "WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Pending ' || text ELSE text END AS text FROM conversations) SELECT conv_id, turn, CASE WHEN starts_with(lower(trim(text)), 'pending ') THEN NULL ELSE text END AS text FROM r")
def f08(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Pending "), F.col("text"))).otherwise(F.col("text"))
    return e.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.lower(F.trim(text)).startswith("pending "), None).otherwise(text).alias("text"))

"""Cluster tables from links: counts, times, scores, terms, texts and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_meaningful
from ..sources import entries as e
from ..sources.tables import once

#: Limits of the lifecycle (hours and counts).
MIN_SOURCES, MIN_PUBLISHERS, STALE_HOURS, EMERGING_HOURS, EMERGING_SOURCES = 3, 2, 48, 24, 3


def linked(spark: SparkSession, d: str) -> DataFrame:
    return linked_with_keywords(spark, d).drop("keywords")


def linked_with_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in clusters' links with their articles but the texts."""
    return once(spark, d, "links", lambda: e.with_keywords(e.linked_articles(spark, d)).withColumnRenamed("id", "article_id").drop("content", "keyword_text"))


def hours_between(early: Column, late: Column) -> Column:
    """Whole hours."""
    return F.floor((F.unix_micros(late) - F.unix_micros(early)) / F.lit(3_600_000_000)).cast("long")


def exact_mean(column: str, digits: int = 4) -> Column:
    """The mean of numbers with ``digits`` decimals, rounded half up on integers, so that the order of adding doesn't matter."""
    unit = 10**digits
    total, n = F.sum(F.round(F.col(column) * unit).cast("long")), F.count("*")
    return F.floor((2 * total + n) / (2 * n)).cast("double") / F.lit(float(unit))


def status_of(n_sources: Column, last_updated: Column, as_of: str) -> Column:
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last_updated)) / F.lit(3_600_000_000)
    return F.when(age >= STALE_HOURS, "stale").when((n_sources < EMERGING_SOURCES) & (age <= EMERGING_HOURS), "emerging").otherwise("active")


def clusters(links: DataFrame, as_of: str = e.AS_OF) -> DataFrame:
    """One row per cluster; all aggregates in one shuffle of partial sums."""
    last = F.struct("published_at", "article_id")
    out = links.groupBy("cluster_id").agg(
        F.count("*").alias("n_sources"),
        F.countDistinct("publisher").alias("n_publishers"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_updated"),
        exact_mean("similarity_score").alias("score"),
        F.max_by("title", last).alias("headline"),
        F.max_by("category", last).alias("topic"),
    )
    return out.withColumn("status", F.when(F.col("n_sources") < MIN_SOURCES, "hidden").otherwise(status_of(F.col("n_sources"), F.col("last_updated"), as_of)))


def top_terms(links: DataFrame, column: str, limit: int, min_count: int, meaningful: bool = True) -> DataFrame:
    """(cluster_id, terms): terms of several articles by frequency; all terms where none is in ``min_count`` articles."""
    terms = links.select("cluster_id", F.explode(F.array_distinct(F.transform(column, F.trim))).alias("term")).filter("term <> ''")
    terms = terms.filter(is_meaningful(F.col("term"))) if meaningful else terms
    counts = terms.groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    # Frequent terms come first, so that the most frequent one says whether any is frequent enough.
    by = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "term")
    ranked = counts.withColumn("r", F.row_number().over(by)).withColumn("most", F.first("n").over(by)).filter(F.col("r") <= limit)
    kept = ranked.filter((F.col("n") >= min_count) | (F.col("most") < min_count))
    return kept.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t")).select("cluster_id", F.col("t.term").alias("terms"))


#: How many terms of each kind are kept of a cluster.
MOST_TERMS = 5


def frequent_terms(links: DataFrame) -> DataFrame:
    """(cluster_id, top_entities, top_keywords): a cluster's meaningful terms by frequency (less, term), :data:`MOST_TERMS` at most, counted once for all that asks for them."""

    def of(kind: str) -> Column:
        terms = F.array_distinct(F.transform(F.coalesce(kind, F.array().cast("array<string>")), F.trim))
        return F.transform(terms, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))

    each = [of("entities"), of("keywords")]
    terms = links.select("cluster_id", F.explode(F.concat(*each)).alias("x")).select("cluster_id", "x.kind", "x.term").filter("term <> ''").filter(is_meaningful(F.col("term")))
    counts = terms.groupBy("cluster_id", "kind", "term").agg((-F.count("*")).alias("less"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy("less", "term"))).filter(F.col("r") <= MOST_TERMS)
    tops = (F.array_sort(F.collect_list(F.when(F.col("kind") == x, F.struct("less", "term")))).alias(f"top_{x}") for x in ("entities", "keywords"))
    return ranked.groupBy("cluster_id").agg(*tops)


def picked(top: str, limit: int, min_count: int) -> Column:
    """The first ``limit`` of a column of :func:`frequent_terms` that are in ``min_count`` articles, all of these where none is; empty without any."""
    first = F.slice(top, 1, limit)
    often = F.filter(first, lambda x: x["less"] <= -min_count)
    return F.coalesce(F.transform(F.when(F.size(often) > 0, often).otherwise(first), lambda x: x["term"]), F.array().cast("array<string>"))


def union_of_terms(links: DataFrame, column: str) -> DataFrame:
    """(cluster_id, terms): all terms of a cluster's articles, sorted."""
    return links.select("cluster_id", F.explode(column).alias("term")).distinct().groupBy("cluster_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))

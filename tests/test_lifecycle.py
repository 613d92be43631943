"""Clusters made anew: few tables in a stage, the same terms and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from __spark_entry__ import queries
from storyloom.functions import quality as q
from storyloom.operators import clusters as c
from storyloom.plans.lifecycle import clusters_before, judged_links, rebuilt

D = "/root/testdata/sf0.001"


def test_frequent_terms(spark):
    """Terms counted once give what counting them for each limit gives."""
    links = c.linked_with_keywords(spark, D)
    tops = links.select("cluster_id").distinct().join(c.frequent_terms(links), "cluster_id", "left")
    for column, limit, least in (("entities", 3, 2), ("entities", 5, 2), ("keywords", 3, 1), ("keywords", 4, 2)):
        made = {r["cluster_id"]: r["x"] for r in tops.select("cluster_id", c.picked(f"top_{column}", limit, least).alias("x")).collect() if r["x"]}
        assert made == {r["cluster_id"]: r["terms"] for r in c.top_terms(links, column, limit, least).collect()} and made


def test_terms_of_none(spark):
    rows = spark.createDataFrame([("a", None, ["storm"]), ("a", ["City Council"], ["storm", "flood"]), ("b", None, None)], "cluster_id string, entities array<string>, keywords array<string>")
    found = c.frequent_terms(rows).select("cluster_id", c.picked("top_entities", 3, 2).alias("e"), c.picked("top_keywords", 3, 2).alias("k")).collect()
    assert [(r["cluster_id"], r["e"], r["k"]) for r in found] == [("a", ["City Council"], ["storm"])]


def test_rebuilt_is_a_join_of_stored_tables(spark):
    """The links are grouped in steps of their own: what is left has a join for the blockers, the clusters before and those without links."""
    rows = rebuilt(judged_links(spark, D), clusters_before(spark, D))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and plan.count("Window ") == 0
    assert rows.filter("n_sources > 0").count() == c.linked(spark, D).select("cluster_id").distinct().count()
    assert rows.filter(F.col("summary").isNull() & (F.col("n_sources") > 0)).isEmpty()


def test_states_are_told_once(spark):
    """What isn't public is told from the state itself: one join of the blockers and the errors, each of which is made once."""
    rows = queries()["j12_not_public"](spark, D)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_controls_are_joined_before_texts(spark):
    """Feeds' controls are joined to places, so that texts go through one join; an annotated entry's patterns aren't asked again by a filter."""
    plan = queries()["f04_annotated"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    joins = [i for i, x in enumerate(lines) if "Join " in x]
    text = next(i for i, x in enumerate(lines) if "text#" in x and "Relation" in x)
    assert sum(i < text for i in joins) == 1
    assert not [x for x in lines if "Filter" in x and "RLIKE" in x.upper()]


def test_names_once(spark):
    """Known names in any case, of equal names the first, generic ones not."""
    rows = spark.createDataFrame([("donald trump met Joe Biden and Joe Biden in Latest News, JOE BIDEN",), ("nothing here",), (None,)], "x string")
    assert [r["n"] for r in rows.select(q.robust_entities(F.col("x")).alias("n")).collect()][:2] == [["Donald Trump", "Joe Biden"], []]

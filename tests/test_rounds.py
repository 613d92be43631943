"""What keeps the clustering's rounds small, against plain ways to the same."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

from storyloom.functions import similarity as s
from storyloom.operators import clustering
from storyloom.plans.pairs import best_candidates, cluster_features

from .test_clustering import NAMES, SCHEMA, cluster_of, stories


def test_near_titles_are_those_whose_blocks_match(spark):
    """The bound by common subsequences loses no near title, and is no bound of letters alone."""
    rng, letters = np.random.default_rng(5), list("abcd efgh")
    titles = ["", "a", *("".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(120))]
    titles += ["".join(x if rng.random() < 0.8 else "z" for x in y) for y in titles[:60]]
    rows = spark.createDataFrame([(x, y) for x in titles for y in titles[::3]], "a string, b string")
    found = rows.select("a", "b", s.near_titles("a", "b").alias("near"), s.title_similarity("a", "b").alias("ratio")).collect()
    plain = [SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0 for r in found]
    assert [r["ratio"] for r in found] == plain
    assert [r["near"] for r in found] == [x >= s.TITLE_SIGNAL for x in plain]
    assert s.common("abcdef", {x: 1 << k for k, x in enumerate("fedcba")}, 6) == 1


def test_features_of_clusters(spark):
    """One join is all that brings a cluster's features together, and they are those of a plain loop."""
    rows = [(*r, f"c{r[0] % 7}") for r in stories(6, 60, 50)]
    made = cluster_features(spark.createDataFrame(rows, SCHEMA + ", cluster_id string"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    for r in made.collect():
        members = sorted((dict(zip(NAMES, x, strict=False)) for x in rows if x[-1] == r["cluster_id"]), key=lambda m: (m["at"], m["article_id"]))
        own = cluster_of(members)
        assert {k: sorted(v) if isinstance(v, list) else v for k, v in own.items()} == {k: sorted(r[f"{k}_"]) if isinstance(v, list) else r[f"{k}_"] for k, v in own.items()}


def test_pairs_of_the_last_round(spark):
    """Each article's pairs are those with the clusters as they were before it, each once, without what only the judgement needed."""
    rows = spark.createDataFrame(stories(8, 30, 60), SCHEMA)
    members, pairs = clustering.clustered(rows, cluster_features, s.evaluated, best_candidates)
    assert pairs.columns == clustering.PAIR and pairs.count() == pairs.select("article_id", "candidate").distinct().count()
    cluster = {r["article_id"]: r["cluster_id"] for r in members.collect()}
    assert {r["candidate"] for r in pairs.select("candidate").collect()} <= set(cluster.values())
    attached = {r["article_id"] for r in pairs.filter("attach").select("article_id").collect()}
    assert {k for k, c in cluster.items() if k != c} <= attached


def test_candidates_come_before(spark):
    """Pairs are dropped by time where postings meet."""
    rows = spark.createDataFrame(stories(9, 40, 20), SCHEMA)
    seen = clustering.seen_articles(rows, rows)
    at = {r["article_id"]: (r["at"], r["article_id"]) for r in rows.collect()}
    found = seen.collect()
    assert found and all(at[r["other"]] < at[r["article_id"]] for r in found) and seen.distinct().count() == len(found)

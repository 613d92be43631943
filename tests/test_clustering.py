"""Clusters made in order of time, against a plain loop over the articles."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest

from storyloom.functions import similarity as s
from storyloom.functions import text as t
from storyloom.operators.clustering import slices_of
from storyloom.plans import clustering
from storyloom.plans.clustering import incremental, live_clusters, reclustered

SCHEMA = """article_id long, at timestamp, title string, display string, raw_keywords array<string>, raw_entities array<string>, keywords array<string>, entities array<string>, own_entities array<string>, primary array<string>, places array<string>,
title_tokens array<string>, title_entities array<string>, topic string, publishers array<string>, content_class string, reasons array<string>, trust string, headline_title string, headline_tokens array<string>"""
START = datetime(2024, 1, 1)
STOP = set(s.CLUSTER_STOPWORDS + s.GENERIC_NEWS_TERMS)


def tokens(text):
    return [x for x in dict.fromkeys(re.split(r"[\s/\-]+", text.lower())) if x]


def telling(text):
    return [x for x in tokens(text) if len(x) > 3 and x not in STOP]


def plain(text):
    return re.sub(r"[^a-z0-9\s]", "", re.sub(r"\s+", " ", text).strip(" ").lower())


def phrase(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def named(entities, title):
    own = tokens(phrase(title))
    return [x for x in entities if (phrase(x) and f" {phrase(x)} " in f" {phrase(title)} ") or set(telling(phrase(x))) & set(own)]


def places_of(title, keywords, entities):
    return sorted({x for x in [*tokens(title), *keywords, *tokens(" ".join(entities))] if x in s.LOCATION_TERMS})


def article(k, hours, title, entities, keywords, publisher="p", topic="world", kind="hard_news"):
    primary = [x for x in entities if " " in x or x in s.LOCATION_TERMS]
    good = len(title.split(" ")) >= 3
    return (k, START + timedelta(hours=hours), title, title, keywords, entities, keywords, entities, entities, primary, places_of(title, keywords, entities), telling(title), named(primary, title), topic, [publisher], kind, [], "normal",
            title if good else "developing coverage around", telling(title) if good else telling(" ".join(["coverage", "around", *keywords, *entities])))


NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]


def meaningful(term):
    term = re.sub("[^a-z0-9]+", " ", term.lower()).strip()
    return term not in t.TERM_BLOCKLIST and len(term) > 2 and any(p not in t.TERM_BLOCKLIST and len(p) > 2 for p in term.split(" "))


def top(members, column, limit, least):
    counts = Counter(x for m in members for x in set(m[column]) if meaningful(x))
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return [x for x, n in ranked if n >= least][:limit] or [x for x, _ in ranked[:limit]]


def cluster_of(members):
    """The features of a cluster of these members."""
    e5, k5 = top(members, "raw_entities", 5, 2), top(members, "raw_keywords", 5, 2)
    head = max(members, key=lambda m: (120 * (2 * len(set(m["raw_entities"]) & set(e5)) + len(set(m["raw_keywords"]) & set(k5))) + min(len(m["display"]), 120), m["at"], m["article_id"]))["display"]
    if len(head.strip(" ").split(" ")) < 3 or plain(head) in ("untitled article", "update"):
        head = "Developing coverage around " + next(iter(top(members, "raw_entities", 3, 2) or top(members, "raw_keywords", 3, 2)), "a developing story")
    out = {c: sorted({x for m in members for x in m[f]}) for c, f in (("keywords", "keywords"), ("entities", "own_entities"), ("primary", "primary"), ("publishers", "publishers"))}
    classes = Counter(m["content_class"] for m in members)
    topics = Counter(m["topic"] for m in members)
    first = {m["topic"]: -k for k, m in reversed(list(enumerate(members)))}
    return out | {"title": plain(head), "title_tokens": telling(plain(head)), "title_entities": named(out["primary"], head), "places": places_of(head, out["keywords"], out["entities"]), "at": max(m["at"] for m in members),
                  "content_class": max(classes, key=lambda c: (classes[c], c)), "topic": max(topics, key=lambda x: (topics[x], first[x]))}


def judge(a, c):
    """(gate, score, entities, keywords, attach) of an article and a cluster, by the rules as they are written."""
    def both(x):
        return set(a[x]) & set(c[x])

    def jaccard(x):
        return len(both(x)) / len(set(a[x]) | set(c[x])) if a[x] or c[x] else 0.0

    title = SequenceMatcher(None, a["title"], c["title"]).ratio() if a["title"] and c["title"] else 0.0
    hours = abs((a["at"] - c["at"]).total_seconds()) / 3600
    time = 0.0 if hours >= 72 else 1 - hours / 72
    semantic = 0.5 * title + 0.3 * jaccard("entities") + 0.2 * jaccard("keywords")
    score = round(0.45 * title + 0.25 * jaccard("entities") + 0.2 * jaccard("keywords") + 0.1 * time, 4)
    ents, keys, place = len(both("entities")), len(both("keywords")), len(both("places"))
    topics = [re.findall("[a-z0-9]+", x["topic"].lower()) for x in (a, c)]
    topic = topics[0] == topics[1] or bool(set(topics[0]) & set(topics[1]) - set(s.TOPIC_BLOCKLIST))
    near, primary, in_titles, close, similar = title >= 0.72, bool(both("primary")), bool(both("title_entities")), time >= 0.8, semantic >= 0.38
    words = len(both("title_tokens"))
    backstop = (ents >= 2 or (ents and place)) and title >= 0.3
    goes_on = primary and in_titles and close and (near or keys >= 2 or similar)
    same_words = words >= 2 and keys >= 3 and similar
    chain = bool(both("publishers")) and topic and close and (near or same_words)
    follows = primary and in_titles and topic and close and title >= 0.3 and keys > 0 and ents >= 2
    kinds = {"e": ents >= 1, "k": keys >= 2, "ts": topic and similar, "tk": topic and title >= 0.3 and keys > 0}
    any_signal = near or place > 0 or goes_on or chain or (topic and same_words) or follows or any(kinds.values())
    gate = any_signal and bool(topic or backstop or goes_on or chain)
    hard = set(s.HARD_NEWS)
    apart = any(({x, y} and ((x in ("service_finance", "evergreen") and y in hard) or (x == "opinion" and y in ("hard_news", "politics", "local_news")) or (x in ("sports", "entertainment") and y in hard))) for x, y in ((a["content_class"], c["content_class"]), (c["content_class"], a["content_class"])))
    if "unknown" in (a["content_class"], c["content_class"]) or a["content_class"] == c["content_class"]:
        apart = False
    shared = both("keywords")
    closed = (
        apart
        or (a["content_class"] == "low_trust_aggregator" and not (near and in_titles and similar))
        or (time <= 0 and not near)
        or (primary and not in_titles and not near and not chain and not (topic and same_words) and not follows)
        or (gate and not primary and not near and not chain)
        or bool(a["places"] and c["places"] and not place and not ents)
        or (len(a["title_tokens"]) >= 2 and len(c["title_tokens"]) >= 2 and not words and not ents)
        or bool(shared and not shared - set(s.GENERIC_NEWS_TERMS) and not ents and not near)
    )
    gate = gate and not closed
    return gate, score, ents, keys, gate and (score >= 0.55 or (round(time, 4) >= 0.8 and (near or any(kinds.values()))))


def one_by_one(rows):
    """{article: cluster} of a loop over the articles in order."""
    clusters, out = {}, {}
    for a in sorted((dict(zip(NAMES, r, strict=True)) for r in rows), key=lambda a: (a["at"], a["article_id"])):
        best = None
        live = [(cluster_of(m), k) for k, m in clusters.items()]
        for c, k in sorted(live, key=lambda x: (x[0]["at"], x[1]), reverse=True):
            if c["at"] < a["at"] - timedelta(hours=72):
                continue
            gate, score, ents, keys, attach = judge(a, c)
            rank = (ents, keys, c["at"], k)
            if gate and (best is None or score > best[0] + 0.02 or (best[0] <= score + 0.02 and rank > best[1])):
                best = score, rank, k, attach
        k = best[2] if best and best[3] else a["article_id"]
        clusters.setdefault(k, []).append(a)
        out[a["article_id"]] = k
    return out


def found_of(members):
    return {r["article_id"]: r["cluster_id"] for r in members.collect()}


PARLIAMENT, VOLCANO = ["norland parliament"], ["mount serra"]
ROWS = [
    article(1, 0, "norland parliament passes water treaty", PARLIAMENT, ["water", "treaty", "vote"], "a"),
    article(2, 1, "norland parliament passes the water treaty", PARLIAMENT, ["water", "treaty", "vote"], "b"),
    article(3, 2, "volcano erupts near harbour town", VOLCANO, ["volcano", "ash", "harbour"], "c"),
    article(4, 30, "norland parliament water treaty passes again", PARLIAMENT, ["water", "treaty", "vote"], "c"),
    article(5, 31, "volcano erupts near the harbour town", VOLCANO, ["volcano", "ash", "harbour"], "a"),
    article(6, 400, "norland parliament passes water treaty", PARLIAMENT, ["water", "treaty", "vote"], "a"),
]


def test_articles_join_in_order_of_time(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    members, pairs = incremental(rows)
    found = found_of(members)
    assert found == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 6} == one_by_one(ROWS)  # the last one comes too late
    assert {r["article_id"] for r in pairs.filter("attach").collect()} == {2, 4, 5}
    assert all((r["similarity"] == 1.0) == (r["cluster_id"] == r["article_id"]) for r in members.collect())
    none, no_pairs = incremental(rows.limit(0))
    assert none.count() == 0 and no_pairs is None
    # Equal times: the smaller id begins.
    twins = [article(9, 0, ROWS[0][2], PARLIAMENT, ["water"]), article(8, 0, ROWS[0][2], PARLIAMENT, ["water"])]
    assert found_of(incremental(spark.createDataFrame(twins, SCHEMA))[0]) == {8: 8, 9: 8}


def stories(seed, n, hours):
    """Articles of stories that share entities, words and near titles, also across topics, so that decisions hang on one another."""
    rng, rows = np.random.default_rng(seed), []
    names = ["norland parliament", "mount serra", "iran", "ukraine", "city league", "harbour bank", "serra", "treaty house"]
    words = "water treaty vote volcano ash harbour budget league match storm bridge power signal court ruling festival latest war".split()
    for k in rng.permutation(n):
        story = int(rng.integers(0, 6))
        base = np.random.default_rng(story)
        title = list(base.choice(words, 6, replace=False))
        for _ in range(int(rng.integers(0, 4))):
            title[rng.integers(0, len(title))] = str(rng.choice(words))
        if rng.random() < 0.1:
            title = title[: int(rng.integers(1, 3))]
        entities = sorted({names[story % len(names)], *(str(x) for x in rng.choice(names, rng.integers(0, 3)))}) if rng.random() < 0.8 else []
        title = " ".join([*title, *(entities[:1] if rng.random() < 0.6 else [])])
        keywords = [str(x) for x in dict.fromkeys([*base.choice(words[:15], 3), *rng.choice(words[:15], 3)])]
        rows.append(article(int(k), float(rng.integers(0, hours * 4)) / 4, title, entities, keywords, f"p{rng.integers(0, 4)}", str(rng.choice(["world", "world news", "sport", "state of play"])), str(rng.choice(["hard_news", "unknown", "opinion", "low_trust_aggregator"], p=[0.6, 0.3, 0.05, 0.05]))))
    return rows


def test_slices_of(spark):
    """Whole steps of time, as many as hold no more than the articles allowed, without gaps that lose an article."""
    at = [datetime(2024, 1, 1) + timedelta(hours=h) for h in (0, 1, 5, 9, 10, 40, 41, 42)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(at)] + [(99, None)], "article_id long, at timestamp")
    for most, n in ((0, 4), (4, 3), (6, 2), (100, 1)):
        found = slices_of(rows, 6, most)
        assert len(found) == n
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(sum(a <= x < b for a, b in found) == 1 for x in at)
    assert slices_of(rows.limit(0), 6, 4) == []


@pytest.mark.parametrize(("seed", "n", "hours", "slice_hours", "slice_articles"), [(1, 45, 60, 72, 1000), (3, 30, 100, 60, 0)])
def test_equals_one_article_after_another(spark, seed, n, hours, slice_hours, slice_articles):
    rows = stories(seed, n, hours)
    expected = one_by_one(rows)
    assert len(set(expected.values())) < n - 3
    assert found_of(incremental(spark.createDataFrame(rows, SCHEMA).repartition(1 + seed), slice_hours=slice_hours, slice_articles=slice_articles)[0]) == expected


def test_run_of_the_tables_equals_one_article_after_another(spark):
    rows, members, pairs = clustering.run(spark, "/root/testdata/sf0.001")
    assert found_of(members) == one_by_one([tuple(r[c] for c in NAMES) for r in rows.collect()])
    assert pairs.filter("NOT topic_match").count() > 0


def test_live_clusters_are_counted(spark):
    rows = stories(4, 50, 300)
    frame = spark.createDataFrame(rows, SCHEMA)
    members, _ = incremental(frame)
    cluster, at = found_of(members), {r[0]: r[1] for r in rows}
    found = {r["article_id"]: r["candidate_count"] for r in live_clusters(members, frame).collect()}
    for k, time in at.items():
        earlier = {cluster[m] for m in at if (at[m], m) < (time, k) and at[m] >= time - timedelta(hours=72)}
        assert found[k] == len(earlier)


def test_recluster_keeps_what_is_older(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    again, touched, _ = reclustered(rows, incremental(rows)[0], "2024-01-02 12:00:00", 10)
    assert found_of(again) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {r["cluster_id"] for r in touched.collect()} == {1, 3, 4, 5, 6}


def test_figures_of_the_run(spark):
    """The run's result and the clusters' figures, against the rows they are made of."""
    d = "/root/testdata/sf0.001"
    out = [r.asDict(recursive=True) for r in clustering.explanations(spark, d).collect()]
    one = clustering.c21(spark, d).first().asDict()
    assert len(one) == 14
    attached = sum(r["decision"] == "attach_existing_cluster" for r in out)
    clusters = {r["cluster_id"]: r.asDict() for r in clustering.run_clusters(spark, d).collect()}
    assert one["updated_count"] == len(out) and one["attach_decisions"] == attached and one["created_count"] == one["new_decisions"] == len(out) - attached == len(clusters)
    assert one["candidates_evaluated"] == sum(r["candidate_count"] for r in out)
    assert one["hidden_total"] + one["active_total"] == len(clusters)
    assert one["promotion_attempts"] == one["promoted_count"] + one["promotion_failures"]
    assert all((r["decision_reason"] == "no_candidate_clusters") == (r["candidate_count"] == 0) for r in out)
    stats = {r["cluster_id"]: r for r in clustering.a13(spark, d).collect()}
    for k in {r["cluster_id"] for r in out}:
        own = [r for r in out if r["cluster_id"] == k]
        scores = [round(r["score"], 4) for r in own if r["score"] is not None]
        assert stats[k]["average_score"] == pytest.approx(sum(scores) / len(scores) if scores else 0.0, abs=1e-4)
        assert stats[k]["class_summary"] == "|".join(sorted(f"{x}:{n}" for x, n in Counter(r["content_class"] for r in own).items()))
        assert stats[k]["signal_gate_seen"] == any(r["gate"] for r in own)


def test_promotion_follows_the_states(spark):
    """A cluster is hidden, then promoted, then hidden again."""
    rows = [("1#1", ["few"], None), ("1#2", ["few"], "short"), ("1#3", [], None), ("1#4", ["stale"], None), ("1#5", ["stale"], None), ("2#1", ["few"], None)]
    found = {(r["cluster_id"], r["n"]): (r["attempted"], r["promoted"]) for r in clustering.promotions(spark.createDataFrame(rows, "cluster_id string, blockers array<string>, validation_error string")).collect()}
    assert found == {("1", 1): (False, False), ("1", 2): (True, False), ("1", 3): (True, True), ("1", 4): (False, False), ("1", 5): (True, False), ("2", 1): (False, False)}


def test_a_stream_closes_the_clusters_of_the_run(spark):
    """What the stream gives out is each cluster's first and last time and number of articles."""
    from storyloom.plans.streams import x04_closing

    d = "/root/testdata/sf0.001"
    rows, members, _ = clustering.run(spark, d)
    at, groups = {r["article_id"]: r["at"] for r in rows.select("article_id", "at").collect()}, {}
    for k, c in found_of(members).items():
        groups.setdefault(str(c), []).append(at[k])
    found = {r["cluster_id"]: (r["start"], r["last"], r["n"]) for r in x04_closing(spark, d).collect()}
    assert found == {c: (f"{min(t):%Y-%m-%d %H:%M:%S}", f"{max(t):%Y-%m-%d %H:%M:%S}", len(t)) for c, t in groups.items()}

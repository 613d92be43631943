"""Features of articles and clusters, and the evaluation of a pair of them."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from .text import words

# Words that tell no story from another.
CLUSTER_STOPWORDS = "a an and are as at be been being blank but by com continue for from get had has have he her his href https in into is it its not of on or our said says she that the their they this to was were will with you your".split()
GENERIC_NEWS_TERMS = "attack attacks breaking ceasefire conflict crisis details developing latest live minister new reported reporting reports story update updates war".split()
LOCATION_TERMS = "gaza iran israel lebanon mali sahel syria ukraine yemen".split()
ENTITY_BLOCKLIST = "accounts america april ballroom best continue deadline future latest".split()
HARD_NEWS = ["hard_news", "politics", "local_news", "business_news", "official_release"]
# Words that two topics may share without being about one thing.
TOPIC_BLOCKLIST = ["analysis", "agencies", "agency", "announced", "announces", "breaking", "breaking news", "city", "commuter", "council", "department", "expand", "expanded", "expands", "feature", "group", "live", "leaders", "mayor", "news", "officials", "police", "publish", "publishes", "report", "reporting", "react", "reacts", "regional", "state", "update", "video", "world news", "eu", "u k", "u s", "uk", "un", "us"]
# Limits of the evaluation.
WINDOW_HOURS, TITLE_SIGNAL, ENTITY_OVERLAP, KEYWORD_OVERLAP, TOPIC_SEMANTIC, OVERRIDE_TITLE, OVERRIDE_TIME, SCORE, TIE = 72, 0.72, 1, 2, 0.38, 0.30, 0.80, 0.55, 0.02


def tokens(text: Column) -> Column:
    """Distinct lower-case words, cut at white space, slashes and hyphens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s/\-]+"), lambda x: x != ""))


def semantic_keywords(keywords: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: (k != "") & ~k.isin(CLUSTER_STOPWORDS) & ~k.isin(GENERIC_NEWS_TERMS)))


def semantic_entities(entities: Column) -> Column:
    def blocked(entity: Column) -> Column:
        return entity.isin(ENTITY_BLOCKLIST) | F.forall(tokens(entity), lambda p: p.isin(ENTITY_BLOCKLIST))

    return F.array_distinct(F.filter(F.transform(entities, lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~blocked(x)))


def primary_entities(entities: Column, classified: Column) -> Column:
    return F.array_distinct(F.concat(semantic_entities(classified), F.filter(semantic_entities(entities), lambda x: x.contains(" ") | x.isin(LOCATION_TERMS))))


def locations(title: Column, keywords: Column, entities: Column) -> Column:
    """``keywords`` and ``entities`` are the semantic ones."""
    all_ = F.concat(tokens(title), keywords, tokens(F.array_join(entities, " ")))
    return F.array_distinct(F.filter(all_, lambda x: x.isin(LOCATION_TERMS)))


def title_tokens(title: Column) -> Column:
    return F.filter(tokens(title), lambda x: (F.length(x) > 3) & ~x.isin(CLUSTER_STOPWORDS) & ~x.isin(GENERIC_NEWS_TERMS))


def phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def in_title(entities: Column, title: Column) -> Column:
    """The entities that a title names in full or by a telling word."""
    plain, own = F.concat(F.lit(" "), phrase(title), F.lit(" ")), tokens(phrase(title))
    return F.filter(entities, lambda x: ((phrase(x) != "") & plain.contains(F.concat(F.lit(" "), phrase(x), F.lit(" ")))) | F.arrays_overlap(title_tokens(phrase(x)), own))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def time_proximity(a: Column, b: Column) -> Column:
    hours = F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(3_600_000_000.0)
    return F.when(hours >= WINDOW_HOURS, 0.0).otherwise(1.0 - hours / WINDOW_HOURS)


def class_mismatch(a: Column, b: Column) -> Column:
    """Whether an article's class keeps it out of a cluster of another class."""
    service, show, news = ["service_finance", "evergreen"], ["sports", "entertainment"], ["hard_news", "politics", "local_news"]

    def apart(x: Column, y: Column) -> Column:
        return (x.isin(service) & y.isin(HARD_NEWS)) | ((x == "opinion") & y.isin(news)) | (x.isin(show) & y.isin(HARD_NEWS))

    return (a != "unknown") & (b != "unknown") & (a != b) & (apart(a, b) | apart(b, a))


def topics_match(a: Column, b: Column) -> Column:
    """Equal keys, or a shared word that isn't blocked. ``a`` and ``b`` are lists of words."""
    shared = F.filter(F.array_intersect(a, b), lambda x: ~x.isin(TOPIC_BLOCKLIST))
    return (F.array_join(a, " ") == F.array_join(b, " ")) | (F.size(shared) > 0)


def matched(x: str, y: str) -> float:
    """Share of matching blocks of two titles, 0 if one is empty."""
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def common(x: str, places: dict[str, int], n: int) -> int:
    """The length of the longest common subsequence of ``x`` and a text of ``n`` letters with these ``places`` (bits) for each letter. Matching blocks together are no longer."""
    open_ = whole = (1 << n) - 1
    for letter in x:
        met = open_ & places.get(letter, 0)
        open_ = ((open_ + met) | (open_ - met)) & whole
    return n - open_.bit_count()


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`matched` of two titles, once for equal pairs of a batch."""
    known: dict[tuple, float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = matched(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def near_titles(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two titles are near; blocks are matched only if the longest common subsequence allows it."""
    places: dict[str, dict[str, int]] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if y not in places:
            bits = places[y] = {}
            for k, letter in enumerate(y):
                bits[letter] = bits.get(letter, 0) | 1 << k
        may_be = 2 * common(x, places[y], len(y)) >= TITLE_SIGNAL * (len(x) + len(y)) - 1e-9
        out.append(may_be and matched(x, y) >= TITLE_SIGNAL)
    return pd.Series(out, dtype="bool")


def evaluated(pairs):
    """Pairs with their overlaps, scores, signals, gate and the first reason against them.

    ``pairs`` has for an article, and with a trailing underscore for a cluster: title, keywords, entities, primary,
    places, title_tokens, title_entities, topic, at, publishers and content_class.
    """
    return evaluator()(pairs)


def evaluator() -> Callable[[DataFrame], DataFrame]:
    """:func:`evaluated` for many tables: its expressions are written once."""

    def both(name: str) -> Column:
        return F.array_intersect(name, f"{name}_")

    steps: list[dict[str, Column]] = [{"title_similarity": title_similarity("title", "title_")}]
    steps.append(
        {
            "entity_jaccard": jaccard(F.col("entities"), F.col("entities_")),
            "keyword_jaccard": jaccard(F.col("keywords"), F.col("keywords_")),
            "time_proximity": time_proximity(F.col("at"), F.col("at_")),
            "topic_match": topics_match(words(F.col("topic")), words(F.col("topic_"))),
            "mismatch": class_mismatch(F.col("content_class"), F.col("content_class_")),
            "entity_overlap": F.size(both("entities")),
            "keyword_overlap": F.size(both("keywords")),
            "location_overlap": F.size(both("places")),
            "title_token_overlap": F.size(both("title_tokens")),
            "source_match": F.size(both("publishers")) > 0,
            "primary_overlap": F.size(both("primary")) > 0,
            "title_entity_overlap": F.size(both("title_entities")) > 0,
        }
    )
    title, time, entity, keyword = (F.col(x) for x in ("title_similarity", "time_proximity", "entity_overlap", "keyword_overlap"))
    semantic_score = 0.5 * title + 0.3 * F.col("entity_jaccard") + 0.2 * F.col("keyword_jaccard")
    steps.append({"semantic_score": semantic_score, "score": F.round(0.45 * title + 0.25 * F.col("entity_jaccard") + 0.2 * F.col("keyword_jaccard") + 0.1 * time, 4)})
    topic, semantic, place = F.col("topic_match"), F.col("semantic_score"), F.col("location_overlap")
    primary, named, near = F.col("primary_overlap"), F.col("title_entity_overlap"), title >= TITLE_SIGNAL
    close, similar, shared = time >= OVERRIDE_TIME, semantic >= TOPIC_SEMANTIC, F.col("title_token_overlap") >= 2
    backstop = ((entity >= max(2, ENTITY_OVERLAP + 1)) | ((entity >= ENTITY_OVERLAP) & (place > 0))) & (title >= OVERRIDE_TITLE)
    continued = primary & named & close & (near | (keyword >= KEYWORD_OVERLAP) | similar)
    telling = shared & (keyword >= KEYWORD_OVERLAP + 1) & similar
    chain = F.col("source_match") & topic & close & (near | telling)
    follow_up = primary & named & topic & close & (title >= OVERRIDE_TITLE) & (keyword > 0) & (entity >= max(2, ENTITY_OVERLAP + 1))
    signals = {
        "strong_title_similarity": near,
        "meaningful_entity_overlap": entity >= ENTITY_OVERLAP,
        "meaningful_keyword_overlap": keyword >= KEYWORD_OVERLAP,
        "location_overlap": place > 0,
        "topic_semantic_similarity": topic & similar,
        "topic_title_keyword_similarity": topic & (title >= OVERRIDE_TITLE) & (keyword > 0),
        "primary_entity_continuity": continued,
        "same_source_update_chain": chain,
        "topic_keyword_title_continuity": topic & telling,
        "topic_followup_continuity": follow_up,
        "near_duplicate_title": near,
    }
    steps.append({"signals": F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in signals.items())))})
    gate = (F.size("signals") > 0) & (topic | backstop | continued | chain)
    generic = (keyword > 0) & (F.size(F.array_except(both("keywords"), F.array(*(F.lit(x) for x in GENERIC_NEWS_TERMS)))) == 0)
    closing = [  # reasons that close the gate, the first one counts
        ("content_class_mismatch", F.col("mismatch")),
        ("low_trust_aggregator_attach_blocked", (F.col("content_class") == "low_trust_aggregator") & ~(near & named & similar)),
        ("story_window_expired", (time <= 0) & ~near),
        ("weak_primary_entity_context", primary & ~named & ~near & ~chain & ~(topic & telling) & ~follow_up),
        ("missing_primary_entity_overlap", gate & ~primary & ~near & ~chain),
        ("location_conflict_without_entity_overlap", (F.size("places") > 0) & (F.size("places_") > 0) & (place == 0) & (entity == 0)),
        ("distinct_event_signatures", (F.size("title_tokens") >= 2) & (F.size("title_tokens_") >= 2) & (F.col("title_token_overlap") == 0) & (entity == 0)),
        ("generic_keyword_only_overlap", generic & (entity == 0) & ~near),
    ]
    closed = F.coalesce(*(F.when(test, F.lit(name)) for name, test in closing))
    noted = F.when(~topic & ~backstop & ~continued, "topic_mismatch").when(F.size("signals") == 0, "weak_semantic_signals")
    steps.append({"rejection": F.coalesce(closed, noted), "gate": gate & closed.isNull()})
    kinds = F.array(*(F.lit(x) for x in ("meaningful_entity_overlap", "meaningful_keyword_overlap", "topic_semantic_similarity", "topic_title_keyword_similarity")))
    override = F.col("gate") & (F.round(time, 4) >= OVERRIDE_TIME) & (F.arrays_overlap("signals", kinds) | near)
    steps += [{"override": override}, {"attach": F.col("gate") & ((F.col("score") >= SCORE) | F.col("override"))}]

    def evaluate(pairs: DataFrame) -> DataFrame:
        for step in steps:
            pairs = pairs.withColumns(step)
        return pairs

    return evaluate

"""Expressions that judge entries: service journalism, stale titles, trust, content class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFTER, BEFORE, any_of_re2, as_re2, known_names, squeeze
from .urls import host_of

# Offers of financial services.
FINANCE_PATTERNS = [
    r"\bbest\s+credit\s+cards?\b",
    r"\bhigh[-\s]?yield\s+savings\b",
    r"\bsavings\s+accounts?\b",
    r"\bcd\s+rates?\b",
    r"\bmortgage\s+rates?\b",
    r"\bhome\s+equity\b",
    r"\bcash\s+out\s+of\s+(?:your\s+)?home\b",
    r"\bhome\b.{0,60}\bcash\b|\bcash\b.{0,60}\bhome\b",
    r"\bpersonal\s+loans?\b",
    r"\bdebt\s+relief\b",
    r"\binsurance\s+quotes?\b",
    r"\bintro\s+apr\b",
    r"\b0%\s+intro\s+apr\b",
    r"\brefinanc(?:e|ing)\b",
]
# Advice and shopping.
SERVICE_PATTERNS = [
    r"\bbest\s+\d+\b",
    r"\b\d+\s+best\b",
    r"\btop\s+\d+\b",
    r"\b\d+\s+ways\b",
    r"\b\d+\+?\s+(?:useful\s+)?products?\b",
    r"\bways\s+to\s+save\b",
    r"\bsave\s+you\s+money\b",
    r"\byou\s+can\s+use\b",
    r"\byou\s+can\s+buy\b",
    r"\byou\s+should\b",
    r"\beasy\s+way\s+to\b",
    r"\bwhat\s+to\s+use\s+instead\b",
    r"\bmake\s+your\s+life\s+easier\b",
    r"\bhow\s+to\s+file\b",
    r"\bgifts?\s+(?:she|he|they|you)'?ll\s+love\b",
    r"\bguide\s+of\s+how\b",
    r"\bsponsored\b",
    r"\bpartner\s+offer\b",
    r"\baffiliate\b",
    r"\bcoupons?\b",
    r"\bdeals?\b",
    r"\bpromo\s+codes?\b",
    r"\bshopping\b",
]
# Sources that are trusted more, or less.
WIRE_PATTERNS = [r"\b(ap|associated press)\b", r"\breuters\b"]
AGGREGATOR_PATTERNS = [r"\bgoogle\s+news\b", r"\bcnn\s+money\b", r"\bmoney_latest\b"]
AGGREGATOR_HOST = "news.google.com"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# What a text contains that has a class, in the order in which classes are tried.
CLASS_TOKENS = [
    ("opinion", ["opinion", "editorial", "analysis", "commentary", "columns"]),
    ("sports", ["nba", "nfl", "mlb", "nhl", "soccer", "football", "basketball"]),
    ("entertainment", ["movie", "album", "celebrity", "box office", "streaming"]),
    ("official_release", ["agency.gov", ".gov/", "department of", "federal register", "press release"]),
    ("local_news", ["phoenix", "arizona", "tempe", "mesa", "scottsdale", "tucson"]),
    ("politics", ["trump", "biden", "senate", "congress", "white house", "election", "governor"]),
    ("business_news", ["stocks", "markets", "earnings", "fed ", "inflation", "tariff", "business"]),
]
HARD_NEWS_TOKENS = ["killed", "shooting", "court", "charged", "war", "ceasefire"]
# Entities that name nothing, and names found whatever their case.
GENERIC_ENTITIES = "accounts america april ballroom best continue deadline details future latest news story today update updates".split()
PUBLIC_FIGURES = ["Ben Sasse", "Donald Trump", "Joe Biden", "Kamala Harris", "Nicolas Maduro", "Vladimir Putin", "Volodymyr Zelensky"]
LOCATIONS = ["Arizona", "Phoenix", "Tempe", "Scottsdale", "Mesa", "Tucson", "United States", "Washington", "White House"]
REASONS = ["stale_content", "affiliate_finance", "service_journalism", "low_trust_aggregator", "insufficient_high_quality_sources"]


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, in any case; each of them begins with \\b."""
    return text.rlike(any_of_re2(patterns))


def contains_any(text: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | text.contains(token)
    return found


def is_stale(title: Column, as_of: str) -> Column:
    """Whether a title names a year or a month before ``as_of``."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    text = F.lower(title)
    stale = F.exists(F.regexp_extract_all(text, F.lit(as_re2(r"\b(20[0-9]{2})\b")), 1), lambda y: y.cast("int") < year)
    for number, name in enumerate(MONTHS, 1):
        dated = F.regexp_extract(text, as_re2(rf"\b{name}\s+(20[0-9]{{2}})\b"), 1)
        of_year = dated.try_cast("int")
        old = (of_year < year) | ((of_year == year) & F.lit(number < month))
        alone = text.rlike(as_re2(rf"\b(?:of|in)\s+{name}\b|\b{name}\s+\d{{1,2}}\b")) & F.lit(number < month)
        stale = stale | F.when(dated != "", old).otherwise(alone)
    return stale


def trust(source_text: Column, feed_url: Column, priority: Column) -> Column:
    """high, normal or low."""
    low = host_of(feed_url).endswith(AGGREGATOR_HOST) | any_of(source_text, AGGREGATOR_PATTERNS) | (priority == "low")
    return F.when(low, "low").when((priority == "high") | any_of(source_text, WIRE_PATTERNS), "high").otherwise("normal")


def is_generic(entity: Column) -> Column:
    return generic_plain(plain_entity(entity))


def plain_entity(entity: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(entity), "[^a-z0-9]+", " "))


def generic_plain(plain: Column) -> Column:
    return (plain == "") | plain.isin(GENERIC_ENTITIES) | F.forall(F.split(plain, " "), lambda p: p.isin(GENERIC_ENTITIES) | (F.length(p) <= 2))


def robust_entities(text: Column) -> Column:
    """Names in order of first sight whatever their case, without generic ones."""
    known = known_names(text, PUBLIC_FIGURES + LOCATIONS)
    found = F.regexp_extract_all(text, F.lit(rf"({BEFORE}[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){{1,3}}{AFTER})"), 1)
    named = F.transform(F.transform(F.concat(known, found), squeeze), lambda x: F.struct(x.alias("name"), plain_entity(x).alias("plain")))
    names = F.transform(F.filter(named, lambda x: ~generic_plain(x["plain"])), lambda x: x["name"])

    def first_seen(own: Column) -> Column:
        return F.filter(own["names"], lambda x, i: F.array_position(own["lowered"], F.lower(x)) == i + 1)

    # As parts of the one element of an array, the names are found once, and lowered once, and not again for each of them.
    both = F.transform(F.array(names), lambda own: F.struct(own.alias("names"), F.transform(own, lambda x: F.lower(x)).alias("lowered")))
    return F.get(F.transform(both, first_seen), F.lit(0))


def content_class(text: Column, trust_: Column, primary: Column, finance: Column | None = None, service: Column | None = None) -> Column:
    """The first class whose test the text meets. ``finance`` and ``service`` say whether the text has such patterns, if that was asked before."""
    lowered = F.lower(text)
    finance = any_of(text, FINANCE_PATTERNS) if finance is None else finance
    service = any_of(text, SERVICE_PATTERNS) if service is None else service
    out = F.when(trust_ == "low", "low_trust_aggregator").when(finance, "service_finance").when(service, "evergreen")
    for name, tokens in CLASS_TOKENS:
        out = out.when(contains_any(lowered, tokens), name)
    return out.when((F.size(primary) > 0) | contains_any(lowered, HARD_NEWS_TOKENS), "hard_news").otherwise("unknown")


def reasons(text: Column, title: Column, trust_: Column, as_of: str, finance: Column | None = None, service: Column | None = None) -> Column:
    """Why an entry is doubtful, in fixed order."""
    finance = any_of(text, FINANCE_PATTERNS) if finance is None else finance
    service = any_of(text, SERVICE_PATTERNS) if service is None else service
    return F.array_compact(F.array(F.when(is_stale(title, as_of), F.lit(REASONS[0])), F.when(finance, F.lit(REASONS[1])), F.when(service, F.lit(REASONS[2])), F.when(trust_ == "low", F.lit(REASONS[3]))))


def rejected(reasons_: Column, allowed: Column) -> Column:
    """Whether a reason is hard and service content isn't allowed."""
    return F.arrays_overlap(reasons_, F.array(*(F.lit(r) for r in REASONS[:3]))) & ~allowed

"""DuckDB SQL that the queries' checks share: the same entries, articles and stand-in clusters."""

from __future__ import annotations

from ..functions.text import ENTITY_STOPWORDS, KEYWORD_STOPWORDS, KNOWN_NAMES


def listed(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


ENTRY = r"""WITH k AS (SELECT *, doc_id - CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS k FROM documents),
np AS (SELECT count(*) AS n FROM pages),
entry AS (
  SELECT k.doc_id AS id, array_to_string(list_slice(string_split_regex(k.text, '\s+'), 1, 12), ' ') AS title,
    regexp_replace(p.url, '^(https?://[^/]+)', concat('\1/d', CAST(k.k AS VARCHAR))) AS url, k.text AS content,
    k.source AS publisher, e.ts AS published_at, e.user_id AS feed_id, e.event_type AS category
  FROM k CROSS JOIN np JOIN pages p ON p.page_id = k.k % np.n JOIN events e ON e.event_id = k.doc_id
)"""


def canonical(url: str) -> str:
    """The canonical form of a column with an address."""
    base, rest = f"split_part(split_part({url}, '#', 1), '?', 1)", f"split_part({url}, '#', 1)"
    query = f"CASE WHEN contains({rest}, '?') THEN regexp_replace({rest}, '^[^?]*\\?', '') ELSE '' END"
    pair = "list_transform(string_split(" + query + ", '&'), lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(regexp_replace(p, '^[^=]*=?', ''), '+', ' '))])"
    kept = f"list_filter({pair}, lambda p: p[2] <> '' AND NOT starts_with(lower(p[1]), 'utm_'))"
    text = f"array_to_string(list_transform({kept}, lambda p: replace(url_encode(p[1]), '%20', '+') || '=' || replace(url_encode(p[2]), '%20', '+')), '&')"
    return f"(CASE WHEN {text} = '' THEN {base} ELSE {base} || '?' || {text} END)"


def squeeze(text: str) -> str:
    return rf"trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g'))"


def plain_title(text: str) -> str:
    return rf"regexp_replace(lower({squeeze(text)}), '[^a-z0-9\s]', '', 'g')"


_KNOWN = ", ".join(f"CASE WHEN regexp_matches(t, '(?i)\\b{n}\\b') THEN '{n}' END" for n in KNOWN_NAMES)


def entities(text: str) -> str:
    # Word borders are doubled, so that each can end one match and begin the next.
    doubled = rf"' ' || regexp_replace({text}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' '"
    found = rf"list_transform(regexp_extract_all({doubled}, '[^\p{{L}}\p{{N}}_]([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}})[^\p{{L}}\p{{N}}_]', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"
    known = f"list_filter([{_KNOWN.replace('matches(t,', 'matches(' + text + ',')}], lambda x: x IS NOT NULL)"
    return f"list_slice(list_sort(list_distinct(list_filter(list_concat({known}, {found}), lambda x: x <> '' AND x NOT IN ({listed(ENTITY_STOPWORDS)})))), 1, 12)"


ARTICLE = (
    ENTRY
    + f""", n1 AS (SELECT * REPLACE (CASE WHEN {squeeze("title")} = '' THEN 'Untitled article' ELSE {squeeze("title")} END AS title) FROM entry),
n2 AS (SELECT *, {canonical("url")} AS canonical_url, {plain_title("title")} AS normalized_title FROM n1),
normal AS (SELECT * REPLACE (substr(content, 1, 10000) AS content), sha256(canonical_url || '|' || normalized_title || '|' || strftime(published_at, '%Y-%m-%d')) AS dedupe_hash,
  title || ' ' || substr(content, 1, 2000) AS keyword_text FROM n2),
art0 AS (SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY id) = 1),
article AS (SELECT *, {entities("keyword_text")} AS entities FROM art0)"""
)

KEYWORDS = (
    ARTICLE
    + rf""", tok AS (SELECT id, unnest(regexp_extract_all(lower(keyword_text), '[a-z][a-z0-9-]{{2,}}')) AS token FROM article),
kc AS (SELECT id, token, count(*) AS n FROM tok WHERE token NOT IN ({listed(KEYWORD_STOPWORDS)}) GROUP BY ALL),
kr AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS r FROM kc QUALIFY r <= 12),
kw AS (SELECT id, list(token ORDER BY r) AS keywords FROM kr GROUP BY id),
full_article AS (SELECT a.*, coalesce(kw.keywords, []) AS keywords FROM article a LEFT JOIN kw USING (id))"""
)


def linked(base: str = ARTICLE, source: str = "article") -> str:
    """Stand-in clusters over articles."""
    return base + f""", pos AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at, id) AS position FROM {source}),
link AS (SELECT 'c' || CAST(feed_id AS VARCHAR) AS cluster_id, id AS article_id, CASE WHEN position = 1 THEN 1.0 ELSE round(1.0::DOUBLE / (1 + position), 4) END::DOUBLE AS similarity_score, * EXCLUDE (id) FROM pos)"""


LINK = linked()
FULL_LINK = linked(KEYWORDS, "full_article")
#: A time as text, to the microsecond.
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(column: str) -> str:
    return STAMP.format(column)

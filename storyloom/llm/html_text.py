"""Main text of web pages: markup, and a suffix array over each host's pages.

A page is cut into blocks by its tags, without what tags and their names mark as menu,
header, footer, sidebar, notice, advert, form, script, style or comments. What is left of a
host's pages is laid end to end as one stream of words. The suffixes of the stream are sorted, and the words that
neighbours have in common (LCP) tell which substrings stand on several distinct pages. Three kinds are boilerplate:

* anywhere, a long substring on many pages: the longer it is, the fewer pages it takes (:func:`pages_needed`);
* at a page's edges, a run of :data:`SHORT` words that is on nearly all pages;
* at a page's edges, a whole block (or what the others leave of it; a list of very short ones is one) that stands on pages of at least :data:`GROUPS` groups as well. Adverts and
  closing lines take turns on a host's pages, so none is on many; but they stand with different articles. Pages that share more than half of
  their words in long substrings are copies of an article and one group, so that its title and its first lines don't count as repeated.

Edges are read from outside in, up to the first block that is none of these, or is a title. Pages with ``article`` or ``main`` have no edges, as their markup
says where the text begins and ends. A page of which no run of :data:`RUN` words would be left stays whole.

A host may have any number of pages. They are dealt by their words to parts of about :data:`PART_PAGES`, each with a suffix
array of its own; only hashes of words are moved. What is on many pages in parts with more than half of the host's pages is boilerplate on all of them, and
so is a block that one part finds at edges of several groups: each page is cleaned alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, written
from .shingles import hash_words, shingle_hashes

#: Words in the shortest substring that counts as repeated.
RUN = 6
#: Such a substring is boilerplate on this share of a part's distinct pages, and on MIN_PAGES at least.
SHARE = 0.5
MIN_PAGES = 5
PART_PAGES = 512
#: Words in the shortest run that counts at edges, if it is on this share of the groups of pages.
SHORT, SHORT_SHARE = 3, 0.9
#: Words in the shortest block that counts as repeated at edges, and on pages of how many groups.
EDGE_WORDS, GROUPS = 4, 2
#: Words in a substring that tells copies, which share more than half of their words in such.
COPIED = 12

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title svg math iframe object select".split()
SKIPPED = frozenset("head nav footer aside form button menu dialog label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
KEPT = frozenset(("html", "body", "article", "main"))
#: Elements that the next block ends, closed or not.
OPEN_ENDED = frozenset("p li dt dd td th tr".split())
NAMES = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adsense|sponsored|sponsor|promo|promotion|banner|cookies?|consent|gdpr|sidebar|side|menu|menubar|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|respond|replies|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|popup|modal|overlay|notice|notices|alert|disclaimer|copyright|widget|pagination|pager|skip|search|toolbar"
)
HEADERS = re.compile("header|head|title")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*+[^>]*+>|.*)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")


def is_noise(name: str, rest: str, inside: bool) -> bool:
    """Whether an element's tag or attributes mark it as something other than the article."""
    if name in SKIPPED or (name == "header" and not inside):
        return True
    if not rest or name in KEPT and not inside:
        return False
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))", re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)):
        return True
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id"):
            words = re.split(r"[^a-z]+", value)
            if any(NAMES.fullmatch(w) for w in words) or not inside and any(HEADERS.fullmatch(w) for w in words):
                return True
    return False


def blocks_of(html: str | None) -> list[str]:
    """The texts of a page's blocks in page order, noise left out; those in ``article`` or ``main`` alone, if any has text."""
    return marked_blocks(html)[1]


def marked_blocks(html: str | None) -> tuple[bool, list[str]]:
    """Whether ``article`` or ``main`` marks where the text is, and :func:`blocks_of`."""
    if not html:
        return False, []
    found: list[tuple[bool, str]] = []
    parts: list[str] = []
    skipped, depth, skip_inside, inside, at = "", 0, False, 0, 0

    def end_block() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((inside > 0, text))
        parts.clear()

    for tag in TAG.finditer(html):
        if not skipped and tag.start() > at:
            parts.append(html[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        closes = bool(tag["close"])
        if skipped:
            if name in MAIN and not closes and not skip_inside and skipped != "head":
                skipped = ""  # an unclosed element doesn't swallow the article
            elif skipped == "head" and name == "body" and not closes:
                skipped = ""
            elif skipped in OPEN_ENDED and name in BLOCKS and not (closes and name != skipped):
                skipped = ""
                if closes:
                    continue
            elif name == skipped:
                depth += -1 if closes else (0 if tag["rest"].endswith("/") else 1)
                if not depth:
                    skipped = ""
                continue
            else:
                if closes and name in MAIN and skip_inside:
                    skipped, inside = "", max(0, inside - 1)
                continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS:
            end_block()
        if not closes and name not in VOID and is_noise(name, tag["rest"], inside > 0):
            skipped, depth, skip_inside = name, 1, inside > 0
        elif name in MAIN:
            inside = max(0, inside + (-1 if closes else 1))
    if not skipped and at < len(html):
        parts.append(html[at:])
    end_block()
    main = [text for within, text in found if within]
    return bool(main), main or [text for _, text in found]


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The places of ``ids`` in the order of the suffixes that start there, by doubling: only suffixes still tied are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.concatenate([[True], np.diff(ids[order]) != 0]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    depth = 1
    while len(tied):
        later = np.where(tied + depth < n, rank[np.minimum(tied + depth, n - 1)] + 1, 0)
        sort = np.lexsort((later, rank[tied]))
        tied, later = tied[sort], later[sort]
        own = rank[tied]
        first = np.concatenate([[True], np.diff(own) != 0])  # of a tie
        new = first | np.concatenate([[True], np.diff(later) != 0])
        at = np.arange(len(tied))
        start = at[first][np.cumsum(first) - 1]
        rank[tied] = own + at[new][np.cumsum(new) - 1] - start
        size = np.diff(np.append(at[new], len(tied)))[np.cumsum(new) - 1]
        tied = tied[size > 1]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many numbers each suffix of ``order`` has in common with the one before it; 0 for the first."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    depth = 0
    while len(live):
        x, y = order[live] + depth, order[live - 1] + depth
        inside = (x < n) & (y < n)
        live = live[inside]
        live = live[ids[x[inside]] == ids[y[inside]]]
        depth += 1
        out[live] = depth
    return out


def pages_needed(length: int, n_pages: int) -> int:
    """On how many of a part's distinct pages a substring of ``length`` words is boilerplate."""
    return max(MIN_PAGES, int(np.ceil(SHARE * n_pages * min(1.0, 2 * RUN / (length + RUN)))))


class HostText:
    """Distinct pages (hashes of words) end to end, the order of the stream's suffixes, and how many words neighbours have in common."""

    def __init__(self, pages: list[np.ndarray]) -> None:
        self.n = n = len(pages)
        # A mark of its own ends each page, so that no substring crosses a border.
        stream = np.concatenate([np.append(p.astype(np.int64) + n, i) for i, p in enumerate(pages)])
        self.page = np.repeat(np.arange(n), [len(p) + 1 for p in pages])
        self.starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pages])])
        self.order = suffix_array(stream)
        self.common = common_prefixes(stream, self.order)
        self.is_mark = stream < n
        self.words = (stream - n).astype(np.uint64)

    def cover(self, places: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Which words are among the ``lengths`` words from ``places`` on."""
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + lengths, -1)
        return np.cumsum(change)[:-1] > 0

    def intervals(self, length: int) -> Iterator[tuple[int, int]]:
        """(first, one beyond the last) of the suffixes that have at least ``length`` words in common one by one."""
        inside = np.flatnonzero(self.common >= length)
        for part in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) else ():
            yield int(part[0]) - 1, int(part[-1]) + 1

    def repeated(self) -> np.ndarray:
        """Which words are in substrings that are boilerplate anywhere."""
        places, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in self.intervals(RUN):
            if len(np.unique(self.page[self.order[begin:end]])) < MIN_PAGES:
                continue
            for a, b, length in repeats(self.common[begin + 1 : end].tolist()):
                own, needed = self.order[begin + a : begin + b], pages_needed(length, self.n)
                if b - a >= needed and len(np.unique(self.page[own])) >= needed:
                    places.append(own)
                    lengths.append(np.full(len(own), length))
        return self.cover(np.concatenate(places), np.concatenate(lengths))

    def groups(self, repeated: np.ndarray) -> np.ndarray:
        """A number for each page, the same for copies of an article; boilerplate (``repeated``) makes no copies."""
        k = np.flatnonzero(self.common >= COPIED)
        x, y = self.order[k], self.order[k - 1]
        own = ~repeated & ~self.is_mark
        copied = self.cover(np.concatenate([x, y]), np.tile(self.common[k], 2)) & own
        copy = 2 * np.bincount(self.page, copied, self.n) > np.bincount(self.page, own, self.n)
        k = (copy[self.page[x]] & copy[self.page[y]]) & ~repeated[x]
        x, y = self.page[x[k]], self.page[y[k]]
        group = np.arange(self.n)
        while True:
            low, new = np.minimum(group[x], group[y]), group.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (new == group).all():
                return group
            group = new[new]

    def short_runs(self, group: np.ndarray) -> np.ndarray:
        """The places of runs of SHORT words that are on nearly all groups of pages."""
        needed = max(MIN_PAGES, int(np.ceil(SHORT_SHARE * len(np.unique(group)))))
        own = [self.order[a:b] for a, b in self.intervals(SHORT) if b - a >= needed]
        return np.concatenate([np.zeros(0, np.int64), *(x for x in own if len(np.unique(group[self.page[x]])) >= needed)])

    def stands_apart(self, start: int, end: int, group: np.ndarray) -> bool:
        """Whether these words stand on pages of GROUPS groups at least."""
        low = high = self.rank[start]
        seen = {group[self.page[start]]}
        while len(seen) < GROUPS and self.common[low] >= end - start:
            low -= 1
            seen.add(group[self.page[self.order[low]]])
        while len(seen) < GROUPS and high + 1 < len(self.order) and self.common[high + 1] >= end - start:
            high += 1
            seen.add(group[self.page[self.order[high]]])
        return len(seen) >= GROUPS

    def edge_blocks(self, lengths: list[np.ndarray], covered: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Hashes of what is repeated at the edges of pages with blocks of ``lengths`` (none: a page without edges)."""
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        known: dict[int, bool] = {}
        for i, own in enumerate(lengths):
            start, end = int(self.starts[i]), int(self.starts[i + 1]) - 1

            def is_known(a: int, b: int) -> bool:
                h = whole_hash(self.words[start + a : start + b])  # noqa: B023
                if h not in known:
                    known[h] = self.stands_apart(start + a, start + b, group)  # noqa: B023
                return known[h]

            if len(own):
                edges(self.words[start:end], covered[start:end], own, is_known)
        return np.sort(np.array([h for h, apart in known.items() if apart], np.uint64))


def whole_hash(words: np.ndarray) -> int:
    return int(shingle_hashes(words, len(words))[0])


def edges(ids: np.ndarray, covered: np.ndarray, lengths: np.ndarray, is_repeated: Callable[[int, int], bool]) -> tuple[int, int]:
    """(first, one beyond the last) of a page's words between its edges: covered words, and what these leave of blocks if it ``is_repeated``.

    A block that the next one begins with is a title, and the text begins with it. Neighbouring blocks of fewer than EDGE_WORDS words, as the links of a menu are, are taken for one."""
    few = lengths < EDGE_WORDS
    ends = np.cumsum(lengths, dtype=np.int64)[~(few & np.append(few[1:], False))]
    cuts = np.union1d(np.concatenate([[0], ends]), np.flatnonzero(np.diff(covered)) + 1).tolist()
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))

    def is_edge(a: int, b: int) -> bool:
        return bool(covered[a]) or (b - a >= EDGE_WORDS and is_repeated(a, b))

    def is_title(a: int, b: int) -> bool:
        return b - a >= EDGE_WORDS and np.array_equal(ids[a:b], ids[b : 2 * b - a])

    first = next((a for a, b in parts if is_title(a, b) or not is_edge(a, b)), len(covered))
    last = next((b for a, b in reversed(parts) if a < first or not is_edge(a, b)), 0)
    return first, max(first, last)


def boilerplate(pages: list[np.ndarray], lengths: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``pages`` (hashes of words): hashes of the runs of RUN words within substrings that are boilerplate anywhere, of the
    runs of SHORT words that are so at edges, and of whole blocks there. ``lengths`` are those of a page's blocks; none: a page without edges."""
    none = np.zeros(0, np.uint64)
    with_lengths = {p.tobytes(): (p, own) for p, own in zip(pages, lengths or [none] * len(pages), strict=True) if len(p) >= RUN}
    if len(with_lengths) < MIN_PAGES:
        return none, none, none
    distinct, own = map(list, zip(*with_lengths.values(), strict=True))
    text = HostText(distinct)
    marked = text.repeated()
    runs = np.unique(np.concatenate([none, *(shingle_hashes(text.words[a:b], RUN) for a, b in runs_of(marked) if b - a >= RUN)]))
    if not any(map(len, own)):
        return runs, none, none
    group = text.groups(marked)
    short = text.short_runs(group)
    hashes = np.unique(shingle_hashes(text.words, SHORT)[short])
    return runs, hashes, text.edge_blocks(own, marked | text.cover(short, SHORT), group)


def repeats(common: list[int]) -> list[tuple[int, int, int]]:
    """The nested intervals of suffixes: (first, one beyond the last, words in common), the innermost first."""
    out, stack = [], [(0, 0)]  # (words in common, first suffix)
    for k, length in enumerate([*common, 0]):
        first = k
        while stack and stack[-1][0] > length:
            deep, first = stack.pop()
            out.append((first, k + 1, deep))
        if not stack or stack[-1][0] < length:
            stack.append((length, first))
    return out


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def hashed(words: list[str]) -> np.ndarray:
    """32 bits of each word's hash."""
    return hash_words([w.encode("utf-8", "surrogatepass") for w in words]) >> np.uint64(32)


def holds(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in ``known`` (sorted)."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def within(ids: np.ndarray, runs: np.ndarray, width: int) -> np.ndarray:
    """Which words are in one of ``runs`` of ``width`` words (sorted hashes)."""
    change = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= width:
        hit = np.flatnonzero(holds(runs, shingle_hashes(ids, width)))
        change[hit] += 1
        np.add.at(change, hit + width, -1)
    return np.cumsum(change)[:-1] > 0


def unique_words(words: list[str], lengths: np.ndarray, runs: np.ndarray, short: np.ndarray, blocks: np.ndarray) -> list[str]:
    """``words`` without boilerplate (:func:`boilerplate`, sorted); all of them if no stretch of RUN words is left."""
    ids = hashed(words)
    gone = within(ids, runs, RUN)
    if len(lengths):
        first, last = edges(ids, gone | within(ids, short, SHORT), lengths, lambda a, b: bool(holds(blocks, np.array([whole_hash(ids[a:b])], np.uint64))[0]))
        gone[:first] = gone[last:] = True
    if not gone.any() or all(b - a < RUN for a, b in runs_of(~gone)):
        return words
    return [w for w, g in zip(words, gone, strict=True) if not g]


def edge_lengths(marked: bool, blocks: list[str]) -> np.ndarray:
    """The numbers of words of a page's blocks; none if its markup says where the text is."""
    return np.array([] if marked else [b.count(" ") + 1 for b in blocks], "<u4")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    A null or empty html, and one without text outside of noise, has the text ''. Truncated and unclosed
    markup is read as far as it goes. Pages without a host keep all that their markup keeps. Repeated rows
    are pages of their own but count once as evidence, whatever part of a text of any length they stand in. Other columns are not
    looked at. An empty table gives no rows.
    """

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    large = written(rows.groupBy("host").agg(F.ceil(F.count("*") / PART_PAGES).alias("n_parts")).filter("host <> '' AND n_parts > 1"), "hosts")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [marked_blocks(h) for h in batch.column(1).to_pylist()]
            words = [hashed(" ".join(blocks).split()).astype("<u4").tobytes() for _, blocks in parsed]
            lengths = [edge_lengths(*p).tobytes() for p in parsed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(lengths, pa.binary())], ["host", "words", "lengths"])

    # Pages are parsed twice, here and below: that costs less than keeping what was parsed.
    known = mapped(rows.filter("host <> ''").select("host", "html"), parse, "host string, words binary, lengths binary", "word hashes").filter("words <> X''")
    dealt = known.join(large, "host", "left").select("host", F.pmod(F.xxhash64("words"), F.coalesce("n_parts", F.lit(1))).alias("part"), "words", "lengths").repartition("host", "part")

    def find(group: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows count once, and always the same one of them.
        group = group.sort_values(["words", "lengths"])
        found = boilerplate([np.frombuffer(w, "<u4") for w in group["words"]], [np.frombuffer(x, "<u4") for x in group["lengths"]])
        return pd.DataFrame({"host": group["host"].iloc[0], "pages": len(group), "kind": range(3), "runs": [x.view(np.int64).tolist() for x in found]})

    parts = written(dealt.groupBy("host", "part").applyInPandas(find, "host string, pages long, kind int, runs array<long>"), "parts")
    half = parts.filter("kind = 0").groupBy("host").agg(F.sum("pages").alias("all"))
    runs = parts.select("host", "pages", "kind", F.explode("runs").alias("run")).groupBy("host", "kind", "run").agg(F.sum("pages").alias("pages")).join(half, "host").filter("kind = 2 OR 2 * pages > all")
    # Of a host's runs, each is on a good share of its pages: they are about as many as a few pages have words. Blocks are those that take turns at its edges.
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("run")))).alias(name) for k, name in enumerate(("runs", "short", "blocks"))]
    runs = written(runs.groupBy("host").agg(*lists), "runs")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, *known in zip(batch.column(2).to_pylist(), *batch.columns[3:], strict=True):
                marked, blocks = marked_blocks(html)
                text = " ".join(blocks)
                if blocks and known[0].is_valid:
                    text = " ".join(unique_words(text.split(" "), edge_lengths(marked, blocks), *(np.sort(k.values.to_numpy().view(np.uint64)) for k in known)))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    texts = mapped(rows.join(runs, "host", "left").select("page_id", "url", "html", "runs", "short", "blocks"), clean, "page_id string, url string, text string", "word hashes")
    return texts.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages"))

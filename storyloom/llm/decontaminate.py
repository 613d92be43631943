"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item leaks into a text if some :data:`WINDOW` characters in a row of the item, or the whole item if it is shorter, stand in
the text with an edit distance of k = floor(:data:`EDITS` * m) at most, m being their number. By the q-gram lemma
such a region shares at least m - q + 1 - k * q q-grams with them, all on k + 1 neighbouring
diagonals (place in the text less place in the item). So, within a task, for each text:

* q-grams that some item has are found by a table of bits, and stretches with too few of
  them are left out;
* the rest are sorted for each text and item by overlapping bands of 2 * (k + 1) diagonals,
  two of which share each diagonal, so that one band has all of a leak's q-grams;
* wherever m characters of the item have as many of a band's q-grams as the lemma asks for, they are verified
  by alignment along the band's diagonals: first the ones with the most, then, if these differ too much, all others.

Items from :data:`LONG` characters on have q-grams of 8 characters, shorter ones of 4, for which the lemma still says
something. Items below :data:`SHORT` characters have no budget: they are sought exactly, as whole words.

Texts and items are compared in lower case, with white space as single spaces. The
benchmark is given to all tasks in blocks of :data:`BLOCK_CHARS` at most; a larger one takes
several passes over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, mapped, table, without_hashes, written

EDITS = 0.08
WINDOW = 120
LONG, SHORT = 40, 13
Q_LONG, Q_SHORT = 8, 4
BLOCK_CHARS = 4_000_000
#: Slots of the table of bits for each q-gram, and slots at most.
SLOTS_EACH, SLOTS = 16, 1 << 24
LEAK = "doc_id long, item_id long, start long, length long, distance int"
END = 0x110000  # no character
TOKEN = re.compile(r"\w+|[^\w\s]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place where one fits."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(q):
            h *= np.uint64(0x100000001B3)
            h += codes[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        return h


@dataclass
class Items:
    """Items of one kind, ready to be looked for."""

    q: int
    ids: np.ndarray
    codes: list[np.ndarray]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.windows = np.minimum(self.lengths, WINDOW)
        self.budgets = np.floor(EDITS * self.windows).astype(np.int64)
        self.bounds = self.windows - self.q + 1 - self.budgets * self.q  # shared q-grams that the lemma asks for
        hashes = [gram_hashes(c, self.q) for c in self.codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        which = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h in hashes)])
        order = np.argsort(flat, kind="stable")
        self.grams, first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.firsts, self.which, self.places = first, which[order], place[order]
        self.slots = min(SLOTS, 1 << max(10, (SLOTS_EACH * len(self.grams)).bit_length()))
        self.bits = np.zeros(self.slots, bool)
        self.bits[self.slot_of(self.grams)] = True

    def slot_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.slots - 1)).astype(np.int64)


@dataclass
class Passages:
    """A block of the benchmark: long and short items, and those sought as whole words, by their number of words."""

    kinds: list[Items] = field(default_factory=list)
    words: dict[int, dict[tuple[str, ...], list[int]]] = field(default_factory=dict)


def passages_of(items: list[tuple[int, str]]) -> Passages:
    """The passages of items (item_id, text). An item of white space alone leaks nowhere."""
    out, by_q = Passages(), {}
    for item_id, text in items:
        text = normal(text)
        c = codes_of(text)
        if len(c) >= SHORT:
            by_q.setdefault(Q_LONG if len(c) >= LONG else Q_SHORT, []).append((item_id, c))
        elif words := tuple(TOKEN.findall(text)):
            out.words.setdefault(len(words), {}).setdefault(words, []).append(item_id)
    out.kinds = [Items(q, np.array([i for i, _ in own], np.int64), [c for _, c in own]) for q, own in sorted(by_q.items())]
    return out


def distances(patterns: list[np.ndarray], regions: list[np.ndarray], slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to a part of its region, and where in the region that part ends.

    ``slack`` is the number of diagonals from the region's first character on that an alignment may use.
    """
    rows, width = max(map(len, patterns)), int(slack.max())
    n = len(patterns)
    text = np.full((n, rows + width + 1), END, np.uint32)
    pattern = np.full((n, rows), END + 1, np.uint32)
    sizes = np.array([len(p) for p in patterns])
    for i, (p, r) in enumerate(zip(patterns, regions, strict=True)):
        pattern[i, : len(p)] = p
        r = r[: rows + width]
        text[i, : len(r)] = r
    x = np.arange(width)
    best, end = np.full(n, rows, np.int64), np.zeros(n, np.int64)
    cost = np.where(x < slack[:, None], 0, rows).astype(np.int64)
    for i in range(rows):
        step = cost + (text[:, i : i + width] != pattern[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step[:, -1] = np.minimum(step[:, -1], rows)
        cost = np.minimum.accumulate(step - x, axis=1) + x
        done = np.flatnonzero(sizes == i + 1)
        if len(done):
            at = cost[done].argmin(1)
            best[done], end[done] = cost[done, at], i + 1 + at
    return best, end


def region(codes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Characters from ``start`` to ``stop``; none stand before the text."""
    own = codes[max(start, 0) : max(stop, 0)]
    return np.concatenate([np.full(min(-start, stop - start), END, np.uint32), own]) if start < 0 else own


def in_bounds(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 below each length, one row after another, and which row each is of."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return values[of] + np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths), of


def leaks_of(codes: list[np.ndarray], items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each (text, item_id) of a leak the distance, and start and length of the region in the text."""
    q, gap = items.q, np.full(items.q, END, np.uint32)  # no q-gram reaches from one text into the next
    stream = np.concatenate([p for c in codes for p in (c, gap)])
    starts = np.cumsum([0, *(len(c) + q for c in codes)])[:-1]
    hashes = gram_hashes(stream, q)
    hits = np.flatnonzero(items.bits[items.slot_of(hashes)])
    # A leak has that many hits within the length of a window and its budget.
    least, longest = int(items.bounds.min()), int((items.windows + items.budgets).max())
    if len(hits) < least:
        return {}
    near = hits[least - 1 :] - hits[: len(hits) - least + 1] < longest
    change = np.zeros(len(hits) + 1, np.int64)
    at = np.flatnonzero(near)
    change[at] += 1
    np.add.at(change, at + least, -1)
    hits = hits[np.cumsum(change)[:-1] > 0]
    known = np.searchsorted(items.grams, hashes[hits])
    known[known == len(items.grams)] = 0
    same = items.grams[known] == hashes[hits]
    hits, known = hits[same], known[same]
    del hashes
    posting, of = in_bounds(items.firsts[known], items.counts[known])
    which, place = items.which[posting].astype(np.int64), items.places[posting].astype(np.int64)
    text = np.searchsorted(starts, hits, side="right")[of] - 1
    most = int(items.lengths.max())
    band = (hits[of] - starts[text] - place + most) // (items.budgets[which] + 1)
    # A band and the one that overlaps it; within each by place in the item.
    text, which, place, band = np.tile(text, 2), np.tile(which, 2), np.tile(place, 2), np.concatenate([band, np.maximum(band - 1, 0)])
    order = np.lexsort((place, band, which, text))
    text, which, place, band = text[order], which[order], place[order], band[order]
    group = np.cumsum(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(which) != 0) | (np.diff(band) != 0)])) - 1
    last = np.arange(len(group)) + items.bounds[which] - 1
    inside = last < len(group)
    inside[inside] = (group[last[inside]] == group[inside]) & (place[last[inside]] - place[inside] <= items.windows[which[inside]] - q)
    first = np.flatnonzero(inside)
    if not len(first):
        return {}
    last = last[first]
    w = which[first]
    # Starts in the item of the windows that hold so many q-grams.
    low = np.maximum(0, place[last] + q - items.windows[w])
    high = np.minimum(place[first], items.lengths[w] - items.windows[w])
    start, row = in_bounds(low, np.maximum(0, high - low + 1))
    row = first[row]
    n_starts = int(items.lengths.max()) + 1
    key = np.unique(group[row] * n_starts + start)
    of_group, start = key // n_starts, key % n_starts
    begin = np.searchsorted(group, of_group)
    text, which, band = text[begin], which[begin], band[begin]
    ordered = group * n_starts + place
    shared = np.searchsorted(ordered, key + items.windows[which] - q, side="right") - np.searchsorted(ordered, key)
    order = np.lexsort((start, -shared, which, text))
    text, which, band, start = text[order], which[order], band[order], start[order]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    top = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(which) != 0)])
    for rows in (np.flatnonzero(top), np.flatnonzero(~top)):
        done = {k[0] * len(items.ids) + k[1] for k in found}
        rows = rows[~np.isin(text[rows] * len(items.ids) + which[rows], list(done))] if done else rows
        for a in range(0, len(rows), 2048):
            part = rows[a : a + 2048]
            k = items.budgets[which[part]]
            begin = band[part] * (k + 1) - most + start[part] - k
            patterns = [items.codes[i][s : s + items.windows[i]] for i, s in zip(which[part], start[part], strict=True)]
            regions = [region(codes[t], b, b + len(p) + 4 * (e + 1)) for t, b, p, e in zip(text[part].tolist(), begin.tolist(), patterns, k.tolist(), strict=True)]
            best, end = distances(patterns, regions, 4 * (k + 1))
            for i in np.flatnonzero(best <= k):
                stop, length = int(begin[i] + end[i]), len(patterns[i])
                pair, leak = (int(text[part[i]]), int(which[part[i]])), (int(best[i]), max(0, stop - length), length)
                if pair not in found or leak < found[pair]:
                    found[pair] = leak
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (t, i), leak in found.items():
        key_ = (t, int(items.ids[i]))
        if key_ not in out or leak < out[key_]:
            out[key_] = leak
    return out


def leaks_in(texts: list[str], passages: Passages) -> list[tuple[int, int, int, int, int]]:
    """Leaks as (number of the text, item_id, start, length, distance): one region for each item in a text.

    Places are those of the text in lower case with single spaces.
    """
    texts = [normal(t) for t in texts]
    codes = [codes_of(t) for t in texts] if passages.kinds else []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for items in passages.kinds:
        for key, leak in leaks_of(codes, items).items():
            if key not in found or leak < found[key]:
                found[key] = leak
    if passages.words:
        for t, text in enumerate(texts):
            at = list(TOKEN.finditer(text))
            words = [m[0] for m in at]
            for n, known in passages.words.items():
                for k in range(len(words) - n + 1):
                    for item in known.get(tuple(words[k : k + n]), ()):
                        start, stop = at[k].start(), at[k + n - 1].end()
                        found[t, item] = min(found.get((t, item), (0, start, stop - start)), (0, start, stop - start))
    return [(t, item, start, length, d) for (t, item), (d, start, length) in sorted(found.items())]


def blocks_of(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[Passages]:
    """The benchmark in blocks of about ``most`` characters; null ids and texts are left out."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // most))
    for block in range(n_blocks):
        yield passages_of([(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, length and distance of each benchmark item that leaks into a document.

    A null or empty text leaks nothing, an empty benchmark neither. Rows with one doc_id are looked
    through each; of equal ids and items one row stays, with the least distance, and rows without an id count as one document.
    Columns other than doc_id and text (item_id and text of the benchmark) are not looked at, whatever their names.
    Texts of any length are looked through whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for passages in blocks_of(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(passages)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
                for a, b in chunks_of(texts, 1_000_000):
                    leaks = leaks_in(texts[a:b], shared.value)
                    columns = list(zip(*leaks, strict=True)) if leaks else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a + t] for t in columns[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.int32())], ["doc_id", "item_id", "start", "length", "distance"])

        found.append(mapped(rows, look, LEAK))
    leaks = found[0]
    for other in found[1:]:
        leaks = leaks.unionByName(other)
    return leaks.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "length")).alias("l")).select("doc_id", "item_id", "l.start", "l.length", "l.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item leaks, with all columns, whatever their names.

    With one block of benchmark, rows aren't moved. With more, each block's pass writes hashes of the texts that go, and rows
    that might be meant are held against them.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    blocks = list(blocks_of(benchmark, block_chars))

    def clean_rows(texts: list[str], passages: Passages) -> np.ndarray:
        clean = np.ones(len(texts), bool)
        for a, b in chunks_of(texts, 1_000_000):
            clean[[a + leak[0] for leak in leaks_in(texts[a:b], passages)]] = False
        return clean

    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(blocks[0])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(clean_rows([t or "" for t in batch.column(at).to_pylist()], shared.value)))

        return mapped(docs, keep, docs.schema)
    gone = None
    for passages in blocks:
        shared = spark.sparkContext.broadcast(passages)

        def leaking(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = ~clean_rows([t or "" for t in batch.column(2).to_pylist()], shared.value)
                yield batch.filter(pa.array(leaks)).select([0, 1])

        hashed = docs.select(F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("print"), "text")
        own = written(mapped(hashed, leaking, "hash long, print long"), "leaking")
        gone = own if gone is None else gone.unionByName(own)
    return without_hashes(docs, F.col("text"), gone.distinct())


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that leak into all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Ranked lexical search by K2-treaps over the grid of terms and documents.

Documents are taken in blocks. A block's grid has a row for each of its terms and a column for each
document; a point is the impact of a term in a document. The grid is a quadtree that is stored compressed:
a bit for each quadrant that holds points, level after level, a cell of a single point as the
rest of that point's place, and with each cell its greatest impact, as the difference from its parent's.

A search starts with a range of all columns and walks down the rows of all the item's terms at once: a
range of columns knows each term's cell in it, so that the weighted sum of their greatest impacts bounds the
scores of the range. The ranges with the highest bounds are halved first, and those below the score of the
k-th best document found so far are left. Blocks are searched by tasks of their own; the best of each are merged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, table, written
from .tokens import Places

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: For each byte, whether it belongs to a term: letters, digits, and all of what isn't ASCII.
IN_TERM = np.array([bool(TERM.match(bytes([b]))) for b in range(256)])
#: Bytes of text, and documents, of a block.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 8192
#: Bytes of a block's row from which it is read by itself.
ROW_BYTES = 1 << 20
#: Characters of items that are searched for in one pass over the index.
PASS_CHARS = 4_000_000
#: Items searched for together, and ranges of each that are halved at a time.
GROUP, HALVED = 32, 48
COUNTED = "n_docs long, n_terms long"
INDEX = "doc_ids array<long>, terms binary, term_sizes binary, dfs binary, height int, level_sizes array<long>, bits binary, drops binary, drop_kind string, rests binary, rest_kind string"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, A-Z in lower case."""
    return TERM.findall(text.encode().lower())


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has, by the bytes that open one."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = IN_TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    opens[first] = inside[first]
    so_far = np.concatenate([[0], np.cumsum(opens)])
    return np.diff(so_far[ends])


def rows_of(docs: DataFrame) -> DataFrame:
    """The documents that take part: those with an id."""
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: the documents with at least one term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            n = term_counts(batch.column(1))
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms]})

    found = mapped(rows_of(docs), count, COUNTED, rows=0).agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a term's weight is multiplied with."""
    m = 100 - 25 + (25 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32 on the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def gathered(x: np.ndarray) -> np.ndarray:
    """The number on the even places: undoes :func:`spread`."""
    x = x.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def least_kind(x: np.ndarray) -> str:
    """The smallest unsigned type for ``x``."""
    most = int(x.max()) if len(x) else 0
    return next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)


def packed_treap(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int) -> dict:
    """The treap of points (no two in one place) on a grid of 2**height rows and columns, as the columns of INDEX."""
    codes = spread(rows)
    codes <<= np.uint64(1)
    codes |= spread(cols)
    order = np.argsort(codes)
    codes, values = codes[order], values[order].astype(np.int32)
    del order
    nibbles, tops, rests, sizes = [], [], [], []
    for level in range(height + 1):
        if not len(codes):
            break
        below = np.uint64(2 * (height - level))
        cells = codes >> below
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        counts = np.diff(np.append(starts, len(codes)))
        single = counts == 1
        sizes.append(len(starts))
        tops.append(np.maximum.reduceat(values, starts))
        rest = np.where(single, codes[starts] & ((np.uint64(1) << below) - np.uint64(1)), np.uint64(0))
        rests.append(rest.astype(least_kind(rest)))
        stays = np.repeat(~single, counts)
        codes, values = codes[stays], values[stays]
        nibble = np.zeros(len(starts), np.uint8)
        if len(codes):
            children = codes >> (below - np.uint64(2))
            firsts = children[np.append(True, children[1:] != children[:-1])]
            parents = np.cumsum(np.append(False, firsts[1:] >> np.uint64(2) != firsts[:-1] >> np.uint64(2)))
            np.add.at(nibble, np.flatnonzero(~single)[parents], (1 << (firsts & np.uint64(3)).astype(np.uint8)).astype(np.uint8))
        nibbles.append(nibble)
    nibble, top = np.concatenate([np.zeros(0, np.uint8), *nibbles]), np.concatenate([np.zeros(0, np.int32), *tops])
    drop = top.copy()
    if len(top):
        drop[1:] = top[np.repeat(np.arange(len(top)), np.bitwise_count(nibble))] - top[1:]
    rest = np.concatenate([np.zeros(0, np.uint8), *rests])
    nibble = np.append(nibble, np.zeros(-len(nibble) % 16, np.uint8))
    return {
        "height": height, "level_sizes": sizes, "bits": (nibble[0::2] | (nibble[1::2] << 4)).tobytes(),
        "drops": drop.astype(kind := least_kind(drop)).tobytes(), "drop_kind": kind, "rests": rest.astype(kind := least_kind(rest)).tobytes(), "rest_kind": kind,
    }


class Treap:
    """A treap to be searched: bits with counts by word, each cell's greatest impact, and the places of single points."""

    def __init__(self, row: dict) -> None:
        self.height, sizes = row["height"], row["level_sizes"]
        self.n = sum(sizes)
        self.words = np.frombuffer(row["bits"], "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        pairs = np.frombuffer(row["bits"], np.uint8)
        self.nibbles = np.stack([pairs & 15, pairs >> 4], 1).ravel()[: self.n]
        self.rests = np.frombuffer(row["rests"], row["rest_kind"])
        drops = np.frombuffer(row["drops"], row["drop_kind"]).astype(np.int32)
        parents = np.repeat(np.arange(self.n, dtype=np.int32), np.bitwise_count(self.nibbles))
        self.tops = drops  # from here on: each cell's own
        start = 1
        for size in sizes[1:]:
            self.tops[start : start + size] = self.tops[parents[start - 1 : start - 1 + size]] - self.tops[start : start + size]
            start += size

    def child(self, cells: np.ndarray, quadrants: np.ndarray) -> np.ndarray:
        """The cells in the quadrants of ``cells``; -1 where there is none."""
        at = 4 * cells + quadrants
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        there = (word >> bit) & np.uint64(1)
        rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where(there > 0, rank + 1, -1)


@dataclass
class Ranges:
    """Ranges of columns, and their pairs with terms that may have points there, in the order of the ranges."""

    item: np.ndarray
    level: np.ndarray
    start: np.ndarray
    bound: np.ndarray
    of: np.ndarray  # of each pair: its range
    row: np.ndarray
    weight: np.ndarray
    cell: np.ndarray  # -1: a single point, in the column ``col``
    col: np.ndarray
    value: np.ndarray

    RANGE = ("item", "level", "start", "bound")
    PAIR = ("of", "row", "weight", "cell", "col", "value")

    def taken(self, which: np.ndarray) -> Ranges:
        """The ranges of a mask, with their pairs."""
        pairs = which[self.of]
        out = Ranges(*(getattr(self, c)[which] for c in self.RANGE), *(getattr(self, c)[pairs] for c in self.PAIR))
        out.of = (np.cumsum(which) - 1)[out.of]
        return out

    def joined(self, other: Ranges) -> Ranges:
        """Both after one another."""
        out = Ranges(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in self.RANGE + self.PAIR))
        out.of[len(self.of) :] += len(self.item)
        return out


def settled(treap: Treap, r: Ranges) -> Ranges:
    """``r`` with single points told apart, pairs without a point in their row and ranges without a pair left out, and bounds."""
    alone = np.flatnonzero((r.cell >= 0) & (treap.nibbles[np.maximum(r.cell, 0)] == 0))
    if len(alone):
        rest = treap.rests[r.cell[alone]].astype(np.uint64)
        level = r.level[r.of[alone]]
        inside = (np.int64(1) << (treap.height - level)) - 1
        r.col[alone] = r.start[r.of[alone]] + gathered(rest)
        right = gathered(rest >> np.uint64(1)) == (r.row[alone] & inside)
        r.cell[alone] = np.where(right, -1, -2)
    keep = r.cell > -2
    if not keep.all():
        for c in Ranges.PAIR:
            setattr(r, c, getattr(r, c)[keep])
    bound = np.zeros(len(r.item), np.int64)
    np.add.at(bound, r.of, r.weight * r.value)
    r.bound = bound
    return r.taken(bound > 0)


def halved(treap: Treap, r: Ranges) -> Ranges:
    """Both halves of each range, with the pairs that go on in them."""
    n, level = len(r.item), r.level[r.of]
    row_bit = (r.row >> (treap.height - 1 - level)) & 1
    middle = r.start + (np.int64(1) << (treap.height - 1 - r.level))
    parts = []
    for side in (0, 1):
        point = r.cell < 0
        cell = np.where(point, -1, 0)
        go = np.flatnonzero(~point)
        found = treap.child(r.cell[go], 2 * row_bit[go] + side)
        cell[go] = np.where(found < 0, -2, found)
        cell[point & ((r.col >= middle[r.of]) != bool(side))] = -2
        keep = cell > -2
        value = np.where(point, r.value, treap.tops[np.maximum(cell, 0)].astype(np.int64))
        parts.append(Ranges(r.item, r.level + 1, middle if side else r.start, r.bound, r.of[keep], r.row[keep], r.weight[keep], cell[keep], r.col[keep].copy(), value[keep]))
    return settled(treap, parts[0].joined(parts[1]))


class Best:
    """For each item the k best documents so far, by score and then by column; ``least`` is the k-th best score, or what is known of it."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = least, k
        self.item, self.col, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, col: np.ndarray, score: np.ndarray) -> None:
        """Documents with their scores, each at most once in all."""
        good = score >= self.least[item]
        item, col, score = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.col, col), (self.score, score)))
        order = np.lexsort((col, -score, item))
        item, col, score = item[order], col[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        keep = place < self.k
        self.item, self.col, self.score = item[keep], col[keep], score[keep]


def search(treap: Treap, terms: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray, k: int, halves: int = HALVED) -> Best:
    """The k best columns for each item of ``terms`` (rows, weights), but none below ``least``, which is raised."""
    best = Best(least, k)
    n = len(terms)
    rows, weights = (np.concatenate([np.zeros(0, np.int64), *(t[x] for t in terms)]) for x in (0, 1))
    of = np.repeat(np.arange(n), [len(t[0]) for t in terms])
    zeros = np.zeros(n, np.int64)
    top = np.full(len(rows), int(treap.tops[0]) if treap.n else 0)
    held = settled(treap, Ranges(np.arange(n), zeros, zeros.copy(), zeros.copy(), of, rows, weights, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), top)) if treap.n else None
    while held is not None and len(held.item):
        held = held.taken(held.bound >= best.least[held.item])
        order = np.lexsort((-held.bound, held.item))
        item = held.item[order]
        now = np.zeros(len(order), bool)
        now[order[np.arange(len(order)) - np.searchsorted(item, item) < halves]] = True
        # A range of single points alone is settled at once: its documents' scores are their sums.
        cells = np.zeros(len(held.item), bool)
        cells[held.of[held.cell >= 0]] = True
        done = now & ~cells
        if done.any():
            r = held.taken(done)
            width = np.int64(1) << treap.height
            docs, place = np.unique(r.item[r.of] * width + r.col, return_inverse=True)
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, place, r.weight * r.value)
            best.add(docs // width, docs % width, score)
        go = now & cells
        rest = held.taken(~now)
        held = rest.joined(halved(treap, held.taken(go))) if go.any() else rest
    return best


def index(docs: DataFrame, n_docs: int, n_terms: int, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The treaps of all documents, written to the shared folder: a row of INDEX for each block.

    ``n_docs`` and ``n_terms`` are the :func:`totals`. A block ends when it has so many documents or bytes; a text is never cut.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, ...]] = []
        places, held_docs, held_bytes = Places(), 0, 0

        def block() -> pa.RecordBatch:
            doc_ids = np.concatenate(ids)
            row, col, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(doc_ids, kind="stable")
            column = np.empty(len(order), np.int32)
            column[order] = np.arange(len(order))
            df = np.bincount(row, minlength=len(places))
            by_df = np.argsort(-df, kind="stable")
            rank = np.empty(len(by_df), np.int32)
            rank[by_df] = np.arange(len(by_df))
            names = list(places)
            names = [names[i] for i in by_df]
            height = max(1, int(max(len(names), len(doc_ids)) - 1).bit_length())
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            found = {"doc_ids": doc_ids[order].tolist(), "terms": b"".join(names), "term_sizes": sizes.astype("<u4").tobytes(), "dfs": df[by_df].astype("<u4").tobytes()}
            found |= packed_treap(rank[row], column[col], value, height)
            ids.clear()
            places.clear()
            return pa.RecordBatch.from_pylist([found], INDEX_ROWS)

        for batch in batches:
            texts = batch.column(1)
            counts = term_counts(texts)
            sizes = texts.cast(pa.large_binary()).nbytes / max(1, len(texts))
            step = max(1, min(256, int(1_000_000 / max(1, sizes))))
            for a in range(0, len(texts), step):
                part = texts.slice(a, step).to_pylist()
                n = counts[a : a + step]
                flat = TERM.findall("\n".join(part).encode().lower())
                if len(flat):
                    terms = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
                    pair, tf = np.unique(np.repeat(np.arange(len(part)), n) << 40 | terms, return_counts=True)
                    doc = pair >> 40
                    parts.append(((pair & ((1 << 40) - 1)).astype(np.int32), (doc + held_docs).astype(np.int32), impacts(tf, n[doc], n_docs, n_terms).astype(np.int32)))
                else:
                    parts.append((np.zeros(0, np.int32),) * 3)
                ids.append(batch.column(0).slice(a, step).to_numpy())
                held_docs, held_bytes = held_docs + len(part), held_bytes + sum(map(len, part))
                if held_docs >= block_docs or held_bytes >= block_bytes:
                    yield block()
                    held_docs = held_bytes = 0
        if held_docs:
            yield block()

    return written(mapped(rows_of(docs), build, INDEX, "treaps", rows=0), "treaps", ROW_BYTES)


INDEX_ROWS = pa.schema([(n, {"array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (c.split() for c in INDEX.split(", "))])


def terms_column(row: dict) -> pa.Array:
    """The terms of a block by row."""
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["term_sizes"], "<u4"), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(row["terms"])])


def document_counts(treaps: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of ``terms``."""
    asked = treaps.sparkSession.sparkContext.broadcast(terms)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        wanted = pa.array(asked.value, pa.large_binary())
        for batch in batches:
            for row in batch.to_pylist():
                at = pc.index_in(wanted, value_set=terms_column(row)).fill_null(-1).to_numpy()
                there = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.frombuffer(row["dfs"], "<u4")[at[there]].astype(np.int64))], ["term", "n"])

    found = treaps.select("terms", "term_sizes", "dfs").mapInArrow(look_up, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {terms[r["term"]]: r["n"] for r in found.collect()}  # of the items of one pass


def weight(df: int, n_docs: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def passes(items: DataFrame, chars: int) -> list[DataFrame]:
    """The items in parts of about ``chars`` characters, each of which fits into a broadcast: row number, id, text."""
    rows = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    total = rows.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    n = -(-total // chars)
    return [rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The k best documents for each item with scores above 0: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are passed over. Documents without an id take no
    part and aren't counted; null and empty texts have no terms. Repeated documents, and repeated items, each count for themselves. Whole texts
    are indexed, however long. An item without terms, or whose terms no document holds, has no row.
    """
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    treaps = index(docs, n_docs, n_terms, block_bytes, block_docs)
    found: list[DataFrame] = []
    for part in passes(items, pass_chars):
        rows = [(r["item"], Counter(terms_of(r["text"]))) for r in part.select("item", "text").collect()]  # of about pass_chars characters
        dfs = document_counts(treaps, sorted({t for _, terms in rows for t in terms}))
        weights = {t: weight(df, n_docs) for t, df in dfs.items()}
        asked = spark.sparkContext.broadcast([(item, [(t, weights[t] * n) for t, n in terms.items() if weights.get(t, 0) > 0]) for item, terms in rows])
        found.append(mapped(treaps, searched(asked, k), "item long, doc_id long, score long", rows=1))
        own = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found[-1] = found[-1].withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).join(part.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
    return reduce(DataFrame.unionByName, found) if found else items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)


def searched(asked, k: int):
    """A function over rows of INDEX that gives each item's best documents of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        items = [x for x in asked.value if x[1]]
        terms = Places()
        each = [(np.array([terms[t] for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)) for _, own in items]
        wanted = pa.array(list(terms), pa.large_binary())
        least = np.ones(len(items), np.int64)  # what a task's blocks have shown of the k-th best score
        for batch in batches:
            for row in batch.to_pylist():
                treap, doc_ids = Treap(row), np.array(row["doc_ids"], np.int64)
                at = pc.index_in(wanted, value_set=terms_column(row)).fill_null(-1).to_numpy().astype(np.int64)
                for a in range(0, len(items), GROUP):
                    group = [(at[t][at[t] >= 0], w[at[t] >= 0]) for t, w in each[a : a + GROUP]]
                    best = search(treap, group, least[a : a + GROUP], k)
                    numbers = np.array([item for item, _ in items[a : a + GROUP]], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[best.item]), pa.array(doc_ids[best.col]), pa.array(best.score)], ["item", "doc_id", "score"])

    return run


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM t WHERE len(terms) > 0
), p AS (
  SELECT d, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY d, doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs
), q AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY i, item_id, term
), s AS (
  SELECT i, item_id, d, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY i, item_id, d, doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

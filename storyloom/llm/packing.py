"""Best-fit packing of token sequences, by matching of large items.

Only the number of pieces of each length decides how bins are filled, and there are
at most ``capacity`` lengths. So the plan is made on counts, which Spark gathers, and
each piece then finds its own place from its length and its rank among the pieces
of that length:

* pieces above a third of the capacity are large. The longest one left opens a bin and
  is matched with the longest large one that still fits beside it, so that a bin has
  at most two of them;
* the rest, longest first, go where the smallest sufficient gap is, and open a bin of
  their own when there is none.

A plan is a list of slots (length, first rank, count, first bin, offset): the pieces
of that length with ranks from ``first rank`` lie at ``offset`` in consecutive bins.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks_of, mapped, table, written
from .tokens import encoder

CAPACITY = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


class Gaps:
    """Runs of consecutive bins by what they have left; the smallest sufficient one is found first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, left: int, first: int, count: int) -> None:
        if left and count:
            if left not in self.runs:
                insort(self.sizes, left)
                self.runs[left] = []
            heapq.heappush(self.runs[left], (first, count))

    def take(self, least: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` bins with the smallest gap of ``least`` or more: gap, first bin, count."""
        at = bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        left = self.sizes[at]
        first, count = heapq.heappop(self.runs[left])
        if count > most:
            heapq.heappush(self.runs[left], (first + most, count - most))
            count = most
        if not self.runs[left]:
            del self.runs[left], self.sizes[at]
        return left, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length; lengths are from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps, bins = Gaps(), 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        slots.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            count = left[a]
            put(a, count, bins, 0)
            gaps.put(capacity - a, bins, count)
        elif a == b:
            count, odd = divmod(left[a], 2)
            put(a, count, bins, 0)
            put(a, count, bins, a)
            gaps.put(capacity - 2 * a, bins, count)
            if odd:  # the last of its length takes the longest one below it, if any
                bins += count
                put(a, 1, bins, 0)
                count = 1
                if at and left[large[at - 1]]:
                    put(large[at - 1], 1, bins, a)
                    gaps.put(capacity - a - large[at - 1], bins, 1)
                else:
                    gaps.put(capacity - a, bins, 1)
        else:
            count = min(left[a], left[b])
            put(a, count, bins, 0)
            put(b, count, bins, a)
            gaps.put(capacity - a - b, bins, count)
        bins += count
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[n]:
            found = gaps.take(n, left[n])
            if found is None:
                # As many to a new bin as fit: one after the other they would each choose it again.
                each = min(capacity // n, left[n])
                count = left[n] // each
                for k in range(each):
                    put(n, count, bins, k * n)
                gaps.put(capacity - each * n, bins, count)
                bins += count
            else:
                gap, first, count = found
                put(n, count, first, capacity - gap)
                gaps.put(gap - n, first, count)
    return [s for s in slots if s[2]]


def cut_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document with their task and their rank among its pieces of one length.

    A null text is empty; its one piece holds the end id. Rows with one doc_id, or without
    any, are documents of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(texts):
                ids, sizes = words.encode_ended(texts[a:b], end_id)
                rows = []
                for doc_id, own in zip(doc_ids[a:b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((doc_id, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), task, int(seen[len(part)])))
                        seen[len(part)] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 5], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), encode, f"{PIECE}, task long, rank long", f"encoder {vocabulary}")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for pieces that :func:`cut_pieces` made and that are stored: their task and rank must not change.

    The driver sees one count for each length. Joined are the lengths' counts for each task and
    the plan; both are bounded by ``capacity`` times the number of tasks and by the capacity alone.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("rank_base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity)
    starts: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, first, offset in slots:
        starts.setdefault(length, []).append((rank, first, offset))
    starts = {n: sorted(s) for n, s in starts.items()}
    table_ = {n: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for n, s in starts.items()}
    shared = spark.sparkContext.broadcast(table_)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            bins, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                first_rank, first_bin, offset = shared.value[int(lengths[rows[0]])]
                at = np.searchsorted(first_rank, ranks[rows], side="right") - 1
                bins[rows] = first_bin[at] + ranks[rows] - first_rank[at]
                offsets[rows] = offset[at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # At most one row for each length and task, and no more than pieces: Spark weighs its size before it broadcasts.
    ranked = pieces.join(by_task, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", end_id: int = 0) -> DataFrame:
    """Whole documents packed into sequences of at most ``capacity`` ids; an empty table gives no row."""
    return pack(written(cut_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a sequence of 2048 ids for each piece of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))

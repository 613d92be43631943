"""Toxicity by a bag of subwords: n-gram embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, a
passage's vector the mean of its words', and a linear softmax tells the passage's class.
Embeddings and softmax are trained jointly in numpy, on a bounded sample of labelled
documents. Misspellings that were never seen share n-grams with the words they stand for.

Labels are of documents, of which a small part may be toxic, and a mean over a long text would hide
it. So a passage is :data:`PASSAGE` words, a document's score that of its highest passage, and
training, after a first pass over all passages, follows each document's highest ones. As all
is linear below the softmax, a word has one number, and all passages of a text are scored by
differences of running sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, crc_of, kept, mapped, sample_by_hash, table
from .ngrams import hashed_features

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SIZE = 12
PASSAGE = 5
#: A feature in fewer documents of the sample has no vector: it would stand for those documents alone.
MIN_DOCS = 3
#: Labelled documents that are learned from, at most, for each label.
SAMPLE = 1200
ROUNDS = 8
WORD = re.compile(r"[^\W_]+")
HELD_OUT = (5, 0)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def passages(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of all passages of texts: values, and the first one and the number of each text.

    ``sums`` has running sums of the words' values with a 0 before them.
    """
    counts = np.maximum(lengths - size, 0) + 1
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(starts, counts)
    width = np.repeat(np.minimum(lengths, size), counts)
    return (sums[at + width] - sums[at]) / width, first, counts


class Model:
    """Embeddings of features, a linear softmax over two classes, and a scale for documents."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.linear = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.scale, self.shift, self.nothing = 1.0, 0.0, 0.0

    def word_values(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each word adds to the difference of the two classes' scores."""
        by_feature = self.vectors @ (self.linear[:, 1] - self.linear[:, 0])
        return np.add.reduceat(by_feature[ids], np.cumsum(counts) - counts).astype(np.float64) / counts

    def fit(self, texts: list[str], labels: list[int], seed: int = 2) -> Model:
        """Adagrad over batches of passages."""
        rng = np.random.default_rng(seed)
        known: dict[str, int] = {}
        docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
        keep = [i for i, d in enumerate(docs) if len(d)]
        docs, y = [docs[i] for i in keep], np.array([labels[i] for i in keep], np.int64)
        if not docs or y.min() == y.max():
            self.shift = 0.0 if not docs else (4.0 if y.max() else -4.0)
            self.linear[:] = 0
            return self
        ids, counts = hashed_features(list(known), BUCKETS, GRAMS)
        first = np.cumsum(counts) - counts
        spread = np.zeros(BUCKETS, np.int64)
        for d in docs:
            own = np.unique(d)
            spread[np.unique(ids[np.repeat(first[own] - np.cumsum(counts[own]) + counts[own], counts[own]) + np.arange(counts[own].sum())])] += 1
        often = spread >= MIN_DOCS
        self.vectors[~often] = 0
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate(docs)
        seen, seen_l, seen_b = np.full((BUCKETS, SIZE), 1e-6, np.float32), np.full((SIZE, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        for epoch in range(ROUNDS):
            if epoch == 0:
                items = [(d, a) for d, n in enumerate(lengths) for a in range(0, n, PASSAGE)]
            else:
                values, begin, n_each = passages(np.concatenate([[0], np.cumsum(self.word_values(ids, counts)[flat])]), starts, lengths)
                top = np.maximum.reduceat(values, begin)
                # A toxic label without a passage above what is usual elsewhere teaches nothing: its text may be quoted, or the label wrong.
                usual = np.median(top[y == 0])
                items = []
                for d in range(len(docs)):
                    if y[d] and top[d] <= usual:
                        continue
                    own = values[begin[d] : begin[d] + n_each[d]].copy()
                    for _ in range(1 if y[d] else 3):
                        a = int(np.argmax(own))
                        if own[a] == -np.inf:
                            break
                        items.append((d, a))
                        own[max(0, a - PASSAGE + 1) : a + PASSAGE] = -np.inf
                    if not y[d]:
                        items.append((d, int(rng.integers(n_each[d]))))
            items = [items[i] for i in rng.permutation(len(items))]
            for b in range(0, len(items), 256):
                part = items[b : b + 256]
                sizes = np.array([min(PASSAGE, lengths[d] - a) for d, a in part])
                words = np.concatenate([docs[d][a : a + PASSAGE] for d, a in part])
                truth = np.eye(2, dtype=np.float32)[y[[d for d, _ in part]]]
                unique, of = np.unique(words, return_inverse=True)
                c = counts[unique]
                own = ids[np.repeat(first[unique] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                vectors = np.add.reduceat(self.vectors[own], np.cumsum(c) - c, axis=0) / c[:, None].astype(np.float32)
                means = np.add.reduceat(vectors[of], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
                logits = means @ self.linear + self.bias
                odds = np.exp(logits - logits.max(1, keepdims=True))
                error = (truth - odds / odds.sum(1, keepdims=True)) / len(part)
                to_means = error @ self.linear.T
                share = np.repeat(to_means / sizes[:, None].astype(np.float32), sizes, axis=0)
                to_words = _sums(of, share, len(unique)) / c[:, None].astype(np.float32)
                features, place = np.unique(own, return_inverse=True)
                grad = _sums(place, np.repeat(to_words, c, axis=0), len(features))
                seen[features] += grad**2
                self.vectors[features] += (0.1 * grad / np.sqrt(seen[features])) * often[features, None]
                grad = means.T @ error
                seen_l += grad**2
                self.linear += 0.1 * grad / np.sqrt(seen_l)
                grad = error.sum(0)
                seen_b += grad**2
                self.bias += 0.05 * grad / np.sqrt(seen_b)
        values, begin, _ = passages(np.concatenate([[0], np.cumsum(self.word_values(ids, counts)[flat])]), starts, lengths)
        top = np.maximum.reduceat(values, begin)
        self.nothing = float(np.median(top[y == 0]))
        self._calibrate(top, y)
        return self

    def _calibrate(self, highest: np.ndarray, y: np.ndarray) -> None:
        """A logistic scale for a document's highest passage, by Newton's method with a weak prior."""
        middle, spread = highest.mean(), highest.std() + 1e-9
        x = np.stack([(highest - middle) / spread, np.ones(len(y))], axis=1)
        w = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * w)
        self.scale, self.shift = float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group."""
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(n))
    return np.add.reduceat(rows[order], starts, axis=0)


class Scorer:
    """Applies a model; remembers the values of words."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.places: dict[str, int] = {}
        self.values = np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Each text's score; a text without words has that of the usual text that isn't toxic."""
        if len(self.places) > self.most:
            self.places, self.values = {}, np.zeros(0)
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in self.places]
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            parts = [self.model.word_values(*hashed_features(new[a : a + 10_000], BUCKETS, GRAMS)) for a in range(0, len(new), 10_000)]
            self.values = np.concatenate([self.values, *parts])
        values = self.values[np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))]
        lengths = np.array([len(w) for w in words], np.int64)
        full = lengths > 0
        highest = np.full(len(texts), self.model.nothing)
        if full.any():
            own = lengths[full]
            means, first, _ = passages(np.concatenate([[0], np.cumsum(values)]), np.cumsum(own) - own, own)
            highest[full] = np.maximum.reduceat(means, first)
        return 1 / (1 + np.exp(-np.clip(self.model.scale * highest + self.model.shift, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of(doc_id) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on the driver to at most ``sample`` documents of each label, none of them held out.

    A document with two labels is toxic if one of them says so; null labels and ids are left out.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    chosen = {r["id"]: r["group"] for r in sample_by_hash(marks, "toxic", "labelled", sample)}
    rows = docs.filter(F.col("doc_id").isin(list(chosen))).select(F.col("doc_id").cast("long").alias("doc_id"), "text").groupBy("doc_id").agg(F.max("text").alias("text")).orderBy("doc_id").collect() if chosen else []
    rows = [r for r in rows if r["text"]]
    return Model().fit([r["text"] for r in rows], [int(chosen[r["doc_id"]]) for r in rows])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs`` (doc_id, text), and predicted (1 from 0.5 on).

    Null and empty texts, and those without a letter or digit, get the score of the usual document that isn't toxic.
    Rows with one doc_id are scored each. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = "scorer" + str(hash((model.scale, model.shift, float(model.linear.sum()))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(texts):
                found = scorer.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, score double, predicted int", key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, learned(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

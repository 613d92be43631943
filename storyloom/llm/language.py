"""Language identification of words by a linear-chain conditional random field.

A text is a chain of words; each word has a language, so that code-switched text gets a
label for each word. A word's features are its affixes and character n-grams, hashed to :data:`FEATURES`
weights for each language, and one for each language whose lexicon has the word. A language's lexicon is
learned: the words that stand in :data:`LEXICON_DOCS` of its labelled documents, of which half make the lexicons and the other
half train the rest, so that training sees words that no lexicon has.

Weights of features and transitions are trained jointly by maximum likelihood (gradients
by forward-backward) on a bounded sample of labelled documents, whose words
take their document's language. Chains that are joined from two languages' documents teach the transitions
what a switch is. Prediction is forward-backward over whole texts; a
document's language has the largest mean of the words' marginals, which is its score.

Long chains are cut into segments for speed, not for the result: products of a
segment's transfer matrices carry exact messages across the cuts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, crc_of, is_latin, kept, mapped, sample_by_hash, table
from .ngrams import hashed_features

FEATURES = 1 << 16
#: Labelled documents that are learned from, at most, for each language.
SAMPLE = 300
#: Documents of a language that a word of its lexicon stands in, at least.
LEXICON_DOCS = 2
#: A chain joined from two languages for so many others.
JOINED = 3
#: Words of a chain in training; longer documents give several chains.
CHAIN = 200
SEGMENT = 256
EPOCHS = 4
#: Numbers that Python's `\w` takes beside digits: of the Latin ones, and all.
LATIN_NUMBERS = "²³¹¼½¾"
NUMBERS = re.compile("[" + "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")) + "]")
WORD = re.compile(rf"[^\W\d_{LATIN_NUMBERS}]+(?:['’][^\W\d_{LATIN_NUMBERS}]+)*")
UNKNOWN = "und"
#: A text whose best language scores less is in none of the learned ones.
LEAST_SCORE = 0.4
HELD_OUT = (4, 2)


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features of words and how many each has: affixes of 1 to 4 characters, n-grams of 1 to 3, and the lexicons that have it.

    ``lexicon`` has bit k of a word's number set if the word is in the lexicon of language k, whose feature is FEATURES + k.
    """
    ids, counts = hashed_features(words, FEATURES, grams=(1, 2, 3), affixes=(2, 3, 4, 5), whole=False)
    known = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    if not known.any():
        return ids, counts
    of, more = np.nonzero(known[:, None] >> np.arange(int(known.max()).bit_length()) & 1)
    ids = np.insert(ids, np.cumsum(counts)[of], FEATURES + more)
    return ids, counts + np.bincount(of, minlength=len(words))


def words_of(text: str) -> list[str]:
    """Words of a text: runs of letters, in lower case."""
    text = text.lower()
    if not is_latin(text) and NUMBERS.search(text):
        text = NUMBERS.sub("0", text)
    return WORD.findall(text)


class Chains:
    """Forward-backward for many chains at once. Scores are emissions (words x K) and transitions (K x K), as exponents."""

    def __init__(self, transitions: np.ndarray, start: np.ndarray) -> None:
        self.step = np.exp(transitions - transitions.max())
        self.start = np.exp(start - start.max())
        self.k = len(start)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Marginals of each word of chains that lie after one another, each of at least one word.

        With ``pairs``, the expected number of transitions of all chains too.
        """
        k, n = self.k, len(emissions)
        weights = np.exp(emissions - emissions.max(1, keepdims=True))
        n_segments = -(-lengths // SEGMENT)
        total = int(n_segments.sum())
        chain = np.repeat(np.arange(len(lengths)), n_segments)
        number = np.arange(total) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        first = np.repeat(np.cumsum(lengths) - lengths, n_segments) + number * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, n_segments) - number * SEGMENT)
        # Segments by descending size, so that those which still have words are a prefix.
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(SEGMENT)]
        at = np.empty(total, np.int64)
        at[order] = np.arange(total)
        # Messages into each segment, from the products of the segments' matrices.
        ahead = np.zeros((total, k))
        behind = np.ones((total, k))
        long = np.flatnonzero((n_segments > 1)[chain][order])
        if len(long):
            f, z = first[long], size[long]
            product = np.tile(np.eye(k), (len(long), 1, 1))
            head = number[order][long] == 0
            for t in range(SEGMENT):
                m = int(np.searchsorted(-z, -t, side="left"))
                if not m:
                    break
                p = product[:m] @ self.step
                if t == 0:
                    p[head[:m]] = self.start  # no step leads to a chain's first word
                p *= weights[f[:m] + t][:, None, :]
                product[:m] = p / p.max(axis=(1, 2), keepdims=True)
            row = np.zeros(total, np.int64)
            row[long] = np.arange(len(long))
            ends = np.cumsum(n_segments)
            for s, e in zip(ends - n_segments, ends, strict=True):
                v = np.eye(k)[0]
                for j in range(s, e - 1):
                    v = v @ product[row[at[j]]]
                    ahead[at[j + 1]] = v = v / v.sum()
                v = np.ones(k)
                for j in range(e - 1, s, -1):
                    v = product[row[at[j]]] @ v
                    behind[at[j - 1]] = v = v / v.sum()
        starts = np.zeros(total, bool)
        starts[at[np.cumsum(n_segments) - n_segments]] = True
        forward = np.empty((n, k))
        v = np.where(starts[:, None], self.start, ahead @ self.step)
        for t in range(SEGMENT):
            m = alive[t]
            if not m:
                break
            v = (v[:m] if t == 0 else v[:m] @ self.step) * weights[first[:m] + t]
            v /= v.sum(1, keepdims=True)
            forward[first[:m] + t] = v
        # Backward: a segment joins when its last word is reached.
        backward = np.empty((n, k))
        v = behind.copy()
        for t in range(SEGMENT - 1, -1, -1):
            m = alive[t]
            if not m:
                continue
            going = size[:m] > t + 1
            v[:m][going] = (v[:m][going] * weights[first[:m][going] + t + 1]) @ self.step.T
            v[:m] /= v[:m].sum(1, keepdims=True)
            backward[first[:m] + t] = v[:m]
        found = forward * backward
        found /= found.sum(1, keepdims=True)
        if not pairs:
            return found
        inner = np.ones(n, bool)
        inner[np.cumsum(lengths) - 1] = False
        i = np.flatnonzero(inner)
        joint = forward[i][:, :, None] * self.step * (weights[i + 1] * backward[i + 1])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return found, joint.sum(0)


class Model:
    """Languages, a weight for each feature and language, and transitions."""

    def __init__(self, languages: list[str]) -> None:
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((FEATURES + k, k), np.float32)
        self.lexicon: dict[str, int] = {}
        self.transitions, self.start = np.zeros((k, k)), np.zeros(k)

    def fit(self, texts: list[str], labels: list[int], seed: int = 1) -> Model:
        """Maximum likelihood by Adagrad over batches of chains."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        ids: dict[str, int] = {}
        chains: list[np.ndarray] = []
        tags: list[np.ndarray] = []
        spread: dict[tuple[str, int], int] = {}
        seen_of = [0] * k
        for text, label in zip(texts, labels, strict=True):
            seen_of[label] += 1
            if seen_of[label] % 2 == 0:  # every other document of a language is for its lexicon
                for w in set(words_of(text)):
                    spread[w, label] = spread.get((w, label), 0) + 1
                continue
            words = [ids.setdefault(w, len(ids)) for w in words_of(text)]
            for a in range(0, len(words), CHAIN):
                chains.append(np.array(words[a : a + CHAIN]))
                tags.append(np.full(len(chains[-1]), label))
        for (w, label), n in spread.items():
            if n >= LEXICON_DOCS:
                self.lexicon[w] = self.lexicon.get(w, 0) | 1 << label
        if not chains:
            return self
        for _ in range(len(chains) // JOINED if k > 1 else 0):
            i, j = rng.integers(len(chains), size=2)
            if tags[i][0] != tags[j][0]:
                a, b = rng.integers(1, len(chains[i]) + 1), rng.integers(1, len(chains[j]) + 1)
                chains.append(np.concatenate([chains[i][:a], chains[j][:b]]))
                tags.append(np.concatenate([tags[i][:a], tags[j][:b]]))
        flat, counts = features_of(list(ids), self.lexicon)
        starts = np.cumsum(counts) - counts
        seen = np.full(self.weights.shape, 1e-6, np.float32)
        seen_t, seen_s = np.full((k, k), 1e-6), np.full(k, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chains))
            for a in range(0, len(order), 32):
                batch = order[a : a + 32]
                lengths = np.array([len(chains[i]) for i in batch])
                words = np.concatenate([chains[i] for i in batch])
                labels_ = np.concatenate([tags[i] for i in batch])
                truth = np.eye(k)[labels_]
                unique, of = np.unique(words, return_inverse=True)
                n_each = counts[unique]
                own = flat[np.repeat(starts[unique] - np.cumsum(n_each) + n_each, n_each) + np.arange(n_each.sum())]
                scores = np.add.reduceat(self.weights[own], np.cumsum(n_each) - n_each, axis=0) / np.sqrt(n_each)[:, None]
                found, steps = Chains(self.transitions, self.start).marginals(scores[of].astype(np.float64), lengths, pairs=True)
                grad = np.zeros((len(unique), k))
                np.add.at(grad, of, truth - found)
                by_feature, place = np.unique(own, return_inverse=True)
                total = np.zeros((len(by_feature), k), np.float32)
                np.add.at(total, place, np.repeat((grad / np.sqrt(n_each)[:, None]).astype(np.float32), n_each, axis=0))
                total = total / len(words) - 1e-6 * self.weights[by_feature]
                seen[by_feature] += total**2
                self.weights[by_feature] += 0.5 * total / np.sqrt(seen[by_feature])
                inner = np.ones(len(labels_), bool)
                inner[np.cumsum(lengths) - 1] = False
                i = np.flatnonzero(inner)
                right = np.bincount(labels_[i] * k + labels_[i + 1], minlength=k * k).reshape(k, k)
                g = (right - steps) / len(words)
                seen_t += g**2
                self.transitions += 0.1 * g / np.sqrt(seen_t)
                heads = np.cumsum(lengths) - lengths
                g = (truth[heads] - found[heads]).mean(0)
                seen_s += g**2
                self.start += 0.05 * g / np.sqrt(seen_s)
        return self


class Tagger:
    """Applies a model; remembers the scores of words."""

    def __init__(self, model: Model, most: int = 100_000) -> None:
        self.model, self.most = model, most
        self.chains = Chains(model.transitions, model.start)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        """Scores of words not seen before, many at once."""
        parts = [self.table]
        for a in range(0, len(words), 10_000):
            ids, counts = features_of(words[a : a + 10_000], self.model.lexicon)
            sums = np.add.reduceat(self.model.weights[ids], np.cumsum(counts) - counts, axis=0)
            parts.append(sums / np.sqrt(counts)[:, None])
        self.table = np.concatenate(parts)

    def tag(self, words: list[list[str]]) -> list[np.ndarray]:
        """Marginals of the words of each text; texts without words get none."""
        if len(self.places) > self.most:
            self.forget()
        flat = [w for ws in words for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in self.places]
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.learn(new)
        at = np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(w) for w in words], np.int64)
        out = self.chains.marginals(self.table[at], lengths[lengths > 0]) if len(flat) else np.zeros((0, len(self.model.languages)))
        return np.split(out, np.cumsum(lengths)[:-1])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Each text's language and the mean marginal of its words; UNKNOWN and 0 without a letter."""
        found = []
        for text, marginals in zip(texts, self.tag([words_of(t) for t in texts]), strict=True):
            if not len(marginals):
                found.append((UNKNOWN, 0.0))
                continue
            mean = marginals.mean(0)
            best = int(np.argmax(mean))
            found.append((self.model.languages[best], float(min(1.0, mean[best]))))
        return found


def sample_of(docs: DataFrame, learn: Column, sample: int) -> list:
    """Rows (text, lang) to learn from: at most ``sample`` of each language, by a hash of the id.

    First the ids of the sample are chosen, a bounded number in every task, then their texts are read.
    """
    ids = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("sample_id"), F.col("lang").alias("sample_lang"))
    wanted = sorted({r["id"] for r in sample_by_hash(ids, "sample_lang", "sample_id", sample)})
    return docs.filter(F.col("doc_id").isin(wanted) & learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang").orderBy("doc_id", "text").limit(4 * len(wanted) + 1).collect() if wanted else []


def learned(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model fitted on the driver to a bounded sample of the rows that ``learn`` allows."""
    rows = [r for r in sample_of(docs, learn, sample) if r["text"]]
    languages = sorted({r["lang"] for r in rows})
    return Model(languages).fit([r["text"] for r in rows], [languages.index(r["lang"]) for r in rows]) if languages else Model([])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``.

    A null text, one without a letter, and any text when no labelled row could be learned from,
    is UNKNOWN with score 0. Repeated rows are predicted each. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = "tagger" + str(hash((tuple(model.languages), float(model.weights.sum()), float(model.transitions.sum()))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept(key, lambda: Tagger(shared.value)) if shared.value.languages else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(texts, 1_000_000):
                found = tagger.predict(texts[a:b]) if tagger else [(UNKNOWN, 0.0)] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), predict, "doc_id long, lang_pred string, score double", key)


def in_a_language(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a language, all columns as they are; rows aren't moved.

    Rejected are texts that are UNKNOWN (null, or without a letter) or whose score is below ``least``.
    Nothing is rejected when no labelled row could be learned from.
    """
    if not model.languages:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    key = "tagger" + str(hash((tuple(model.languages), float(model.weights.sum()), float(model.transitions.sum()))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept(key, lambda: Tagger(shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [p for a, b in chunks_of(texts, 1_000_000) for p in tagger.predict(texts[a:b])]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return mapped(docs, keep, docs.schema, key)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of(doc_id) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

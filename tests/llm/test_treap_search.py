"""Ranked search by treaps, against plain scoring of all documents and against SQL."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import treap_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k):
    """The contract, document by document."""
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs if d is not None]
    n_docs, total = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in terms:
            m = 100 - 25 + (25 * c.total() * n_docs) // max(1, total)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found_of(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


WORDS = [f"w{i}" for i in range(60)] + ["Ünter", "ünter", "日本", "A1", "a1", "x_y", "it's", "\U0001f600"]
ODD_DOCS = [(1, None), (2, ""), (3, "..., --"), (4, "one"), (4, "one"), (None, "one two"), (-5, "ONE two\x00three"), (6, "one " * 70_000), (7, "z" * 500_000 + " two"), (8, "\x7f\x80é²½"), (9, "two one one"), (10, "one two three four")]
ODD_ITEMS = [(1, "One two"), (1, "one"), (None, "three four four"), (2, None), (3, ""), (4, "nowhere"), (5, "é² \x80"), (6, "one " * 5000)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("item_id", "item", "rank", "score", "terms", "bits")))
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("doc_id", "item", "rank", "score")))
    for block_docs in (1, 3, 8192):
        assert found_of(treap_search.ranked(docs.repartition(2), items, 5, block_docs=block_docs, pass_chars=15_000)) == plain_ranks(ODD_DOCS, ODD_ITEMS, 5)
    assert treap_search.ranked(docs.limit(0), items).count() == 0
    assert treap_search.ranked(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_scoring(spark, seed):
    rng = np.random.default_rng(seed)

    def text(most):
        return " ".join(rng.choice(WORDS, rng.integers(0, most), p=np.arange(len(WORDS), 0, -1) / (len(WORDS) * (len(WORDS) + 1) / 2)))

    docs = [(int(i), text(80)) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)]  # many ties
    items = [(i, text(40)) for i in range(70)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert found_of(treap_search.ranked(*frames, 7, block_docs=(40, 8192, 130)[seed])) == plain_ranks(docs, items, 7)


@pytest.mark.parametrize("seed", range(6))
def test_treap_holds_its_points(seed):
    """Each row's points are found by walking down with one term, and cells' values bound what is below."""
    rng = np.random.default_rng(seed)
    height = int(rng.integers(1, 9))
    n = int(rng.integers(1, min(4**height, 3000) + 1))
    places = rng.choice(4**height, n, replace=False)
    rows, cols, values = places >> height, places & ((1 << height) - 1), rng.integers(1, 100_000, n)
    packed = treap_search.packed_treap(rows, cols, values, height)
    treap = treap_search.Treap(packed)
    assert treap.n == sum(packed["level_sizes"]) and treap.tops[0] == values.max()
    asked = [(np.array([r]), np.array([3])) for r in range(1 << height)]
    best = treap_search.search(treap, asked, np.ones(len(asked), np.int64), 1 << height)
    assert sorted(zip(best.item, best.col, best.score, strict=True)) == sorted(zip(rows, cols, 3 * values, strict=True))


def test_search_leaves_ranges_out(monkeypatch):
    """With a sum of many terms and few high documents, most columns are never reached."""
    rng = np.random.default_rng(1)
    rows, cols = (x.ravel() for x in np.meshgrid(np.arange(32), np.arange(1024), indexing="ij"))
    values = rng.integers(1, 50, len(rows))
    values[(cols % 100 == 7)] += 1000
    reached = []
    halved = treap_search.halved
    monkeypatch.setattr(treap_search, "halved", lambda t, r: reached.append(len(r.item)) or halved(t, r))
    treap = treap_search.Treap(treap_search.packed_treap(rows, cols, values, 10))
    best = treap_search.search(treap, [(np.arange(32), np.ones(32, np.int64))], np.ones(1, np.int64), 5, 8)
    scores = np.bincount(cols, values)
    assert best.col.tolist() == np.lexsort((np.arange(1024), -scores))[:5].tolist() and sum(reached) < 400


def test_term_counts():
    texts = ["", "a", "a b", " ab, c", None, "é\x80x y", "b", "1_2"]
    for part in (pa.array(texts), pa.array(texts).slice(2), pa.array(["", ""]), pa.array([], pa.string())):
        assert treap_search.term_counts(part).tolist() == [len(TERM.findall(t or "")) for t in part.to_pylist()]


def test_equals_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    assert found_of(treap_search.op11_ranked_search(spark, "/root/testdata/sf0.01")) == sorted((tuple(r) for r in db.execute(treap_search.OP11_SQL).fetchall()), key=repr)


def test_blocks_are_read_one_by_one(spark, monkeypatch):
    """Each block of a task is a row group of its own, so that a reader holds one, however many a task has made."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(treap_search, "ROW_BYTES", 1000, raising=False)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * i) % 997}" for i in range(1, 60))) for k in range(2000)], "doc_id long, text string").coalesce(1)
    treaps = treap_search.index(docs, *treap_search.totals(docs), block_docs=10)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in treaps.inputFiles()]
    assert sum(m.num_rows for m in files) >= 4
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))

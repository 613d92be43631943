"""MinHash near-duplicates by a join of signature coordinates.

A text is a set of word shingles. Equal sets are one *node*. A node's signature has
:data:`COORDINATES` minimum hashes, and nodes are posted under each coordinate's value. Two
sets of similarity 0.8 agree in 38 of 48 coordinates on average; in fewer than
:data:`MATCHES` with a chance below 2e-5. So a pair with that many matches is sought:

* Values that one node alone has are dropped, and so are nodes with fewer than MATCHES
  values left: nothing can match them often enough.
* Of the rest, sorted by frequency, a pair that matches MATCHES times shares a value among the
  COORDINATES - MATCHES + 1 rarest of each. Only these prefixes make pairs; the long
  postings are skipped and only counted for pairs that the prefixes made.

Within a posting no node meets all others. First each meets the posting's most typical node, the one
whose values most nodes share: what copies were made from is near all of them, though they may not be
near one another. Pairs that match often enough are confirmed on the full sets, and linked nodes become
components. Postings whose nodes are all in one component are done. In the others each node meets a
node drawn for the posting, so that it meets many. What is left are groups of nodes that share
values and aren't all linked, such as copies that have changed too much. Such a group is cut into blocks of
:data:`BLOCK` nodes; each pair of blocks is compared on its full sets in one task, as a product of
matrices, and only links that join components come out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, mapped, table, without_hashes, written
from .components import connected_components
from .shingles import fingerprint, shingle_set
from .sketch import might_hold, sketch_of

COORDINATES = 48
MATCHES = 26
PERCENT = 80
BLOCK = 256
#: Bits of the sketch of document ids whose sets are needed; beyond its capacity more sets than needed are read.
SKETCH_BITS = 1 << 24
_random = np.random.default_rng(20)
FACTORS = _random.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 1 << 63, COORDINATES, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minimum hashes for each set, none of which is empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            out[:, k] = np.minimum.reduceat((flat * FACTORS[k] + ADDENDS[k]) >> np.uint64(32), starts)
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (16 bytes; null if the set is empty) and signature of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks_of([t or "" for t in texts]):
                sets = [shingle_set(t, width) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full).view(np.int32).tolist() if full else [])
                columns = [batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "signature"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, "doc_id long, n_shingles long, node binary, signature array<int>", "word hashes")


def prefixes(nodes: DataFrame) -> DataFrame:
    """(value, node, n, weight) for the values that can make pairs; a node's weight says how many nodes share its values."""
    values = nodes.select("node", "n", F.posexplode("signature").alias("k", "v")).select("node", "n", F.xxhash64("k", "v").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    held = values.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("nodes", "value"))).alias("held"))  # at most COORDINATES
    held = held.filter(F.size("held") >= MATCHES)
    weight = F.aggregate("held", F.lit(0).cast("long"), lambda w, h: w + h["nodes"])
    return held.select("node", "n", weight.alias("weight"), F.explode(F.expr(f"slice(held, 1, size(held) - {MATCHES - 1})")).alias("h")).select(F.col("h.value").alias("value"), "node", "n", "weight")


def might_be_near(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (F.least(n_a, n_b) * 100) >= (F.greatest(n_a, n_b) * percent)


def matches(s: Column, t: Column) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(s, t, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose signatures match often enough."""
    of_a, of_b = nodes.select(F.col("node").alias("a"), F.col("signature").alias("s")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of_a, "a").join(of_b, "b")
    return both.filter(matches(F.col("s"), F.col("t")) >= MATCHES).select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents whose doc_id is in ``ids``, and of some more.

    A sketch of fixed size tells which documents might be meant, so that the others' texts are neither
    moved nor cut up again. Rows without a doc_id are always read.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SKETCH_BITS))
    words = ids.filter("doc_id IS NOT NULL").select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SKETCH_BITS}) % 32 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    sketch = np.zeros(SKETCH_BITS // 32, np.uint32)
    sketch[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(sketch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).to_numpy()
            wanted = np.flatnonzero((shared.value[bits >> 5] >> (bits & 31).astype(np.uint32)) & np.uint32(1) | batch.column(0).is_null().to_numpy(zero_copy_only=False))
            texts = batch.column(2).take(pa.array(wanted)).to_pylist()
            for a, b in chunks_of([t or "" for t in texts]):
                sets = [s for s in (shingle_set(t, width) for t in texts[a:b]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, sets), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bit.alias("bit"), "text")
    return mapped(rows, cut, "node binary, shingles binary", "word hashes").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for s, t in zip(batch["s"], batch["t"], strict=True):
                x, y = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(near, bool), ["a", "b"]]

    of_a, of_b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(s)) for k, s in (("a", "s"), ("b", "t")))
    return pairs.join(of_a, "a").join(of_b, "b").mapInPandas(check, "a binary, b binary")


def linked_in_blocks(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different labels that postings hold together, directly or by way of others."""
    first = postings.groupBy("value").agg(F.min("node").alias("b"))
    groups = connected_components(postings.join(first, "value").select(F.col("node").alias("a"), "b").distinct())
    nodes = postings.select("node", "label").distinct().join(groups.withColumnRenamed("label", "held"), "node")
    sizes = nodes.groupBy("held").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("held", "blocks")
    nodes = nodes.join(sizes, "held").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(sets, "node")
    each = nodes.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("held", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "shingles")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_between(pdf["node"].tolist(), pdf["label"].tolist(), [np.frombuffer(s, "<u8") for s in pdf["shingles"]], pdf["block"].to_numpy(), percent), columns=["a", "b"])

    return each.groupBy("held", "i", "j").applyInPandas(link, "a binary, b binary")


def links_between(nodes: list[bytes], labels: list[bytes], sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join labels, enough to connect all that such links connect; of two blocks only those between them."""
    values, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1
    place = np.cumsum(shared) - 1
    kept = shared[of]
    row, of = row[kept], place[of[kept]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(of, (start, start + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], of[a:b] - start] = 1
        both += part @ part.T
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if blocks.min() != blocks.max():
        near &= blocks[:, None] != blocks[None, :]
    number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    own = np.array([number[x] for x in labels])
    near &= own[:, None] != own[None, :]
    parent = list(range(len(number)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        x, y = root(int(own[i])), root(int(own[j]))
        if x != y:
            parent[x] = y
            out.append((nodes[i], nodes[j]))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Rows are linked if 100 * |both| >= percent * |either| for their sets of ``width``-word shingles; a
    component is what links connect, and its id the smallest doc_id in it. A text shorter than
    ``width`` words is one shingle. Null and empty texts, and those of white space, have no shingle and
    are components of their own. Equal texts are linked whatever their ids; a row without a doc_id is
    kept only if no row of its component has one. An empty table gives no rows.
    """
    rows = written(signed(docs, width), "signatures")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    posted = written(prefixes(nodes), "postings")
    # Postings of one node are done from the start.
    open_ = posted.join(posted.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1").select("value"), "value")
    open_ = written(open_, "postings")
    links = None
    labels = None
    near_sets = written(sets_of(docs, open_.select("node").distinct().join(nodes, "node").select("doc_id"), width), "sets")
    typical, drawn = F.struct("weight", "node", "n", "label"), F.struct(F.xxhash64("value", "node"), "node", "n", "label")
    for hub in (typical, drawn, None):
        if open_.isEmpty():
            break
        own = open_.withColumn("label", F.col("node")) if labels is None else open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = own.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("value")
        open_ = written(own.join(mixed, "value").select("value", "node", "n", "weight", "label"), "postings")
        if hub is not None:
            hubs = open_.groupBy("value").agg(F.max(hub).alias("h"))
            pairs = open_.join(hubs, "value").select("node", "n", "label", F.col("h.node").alias("node_"), F.col("h.n").alias("n_"), F.col("h.label").alias("label_"))
            pairs = pairs.filter((F.col("label") != F.col("label_")) & might_be_near(F.col("n"), F.col("n_"), percent)).select(F.col("node").alias("a"), F.col("node_").alias("b"))
            found = written(confirmed(matching(pairs, nodes), near_sets, percent), "links")
        else:
            found = written(linked_in_blocks(open_, near_sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
        open_ = open_.drop("label")
    own = rows.select("doc_id", "n_shingles", "node")
    if labels is not None:
        own = own.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    own = written(own, "labelled")
    least = own.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, all columns as they are.

    Rows that share a doc_id stay or go together, and so do rows without one.
    """
    found = near_duplicates(docs, width, percent)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select(F.xxhash64("doc_id").alias("hash"), F.xxhash64(F.lit(1), "doc_id").alias("print"))
    return without_hashes(docs, F.col("doc_id").cast("long"), gone)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM w
), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * hit >= 80 * (len(sa.s) + len(sb.s) - hit)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS n, doc_id AS c FROM s UNION SELECT r.n, e.b FROM r JOIN e ON r.c = e.a
), c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.n
"""

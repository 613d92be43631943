"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights: its components are the terms. Candidates
are stored in blocks of posting lists, one list per term: the places in the block whose
weight isn't 0, and the weights. A block of queries meets a block of candidates; for one
term after another, the queries' weights times the postings are scattered into a
dense array of scores. Each query's best k of the block are selected by partition, and
what the blocks found is merged.

Queries and candidates meet as blocks of :data:`QUERY_BLOCK` and :data:`BLOCK` vectors,
joined on a block number; what is shuffled is the candidates' postings once for each block of
queries, and k rows for each query and block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 4096
QUERY_BLOCK = 2048
#: Queries whose scores are held at once, times BLOCK.
TILE = 256
LONG = np.iinfo(np.int64)
FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; what a long can't hold becomes its least or largest value."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"), F.lit(float(LONG.min))), F.lit(float(LONG.max))).cast("long"))


def matrix(lists: pd.Series) -> np.ndarray:
    """Rows of weights; shorter rows are filled with 0."""
    lengths = lists.map(len).to_numpy()
    rows = np.zeros((len(lists), int(lengths.max()) if len(lists) else 0), np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *lists.map(np.asarray)])
    rows[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return rows


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows in which its weight isn't 0, and the weights."""
    return [(at, rows[at, t]) for t in range(rows.shape[1]) for at in [np.flatnonzero(rows[:, t])]]


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of ``n`` candidates for each query, exact; values beyond a long become its least or largest."""
    terms = min(queries.shape[1], len(lists))
    bound = sum(int(np.abs(queries[:, t].astype(object)).max(initial=0)) * int(np.abs(lists[t][1].astype(object)).max(initial=0)) for t in range(terms)) if _large(queries, lists) else 0
    kind = object if bound > LONG.max else np.int64
    scores = np.zeros((n, len(queries)), kind)
    for t in range(terms):
        places, of_term = lists[t]
        asked = queries[:, t].astype(kind)
        if len(places) == n:
            scores += of_term.astype(kind)[:, None] * asked
        elif len(places):
            scores[places] += of_term.astype(kind)[:, None] * asked
    return np.clip(scores, LONG.min, LONG.max).astype(np.int64).T if kind is object else scores.T


def _large(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether a sum of products might pass a long."""
    most = 2**31 // max(1, int(np.sqrt(max(1, queries.shape[1]))))
    return bool((queries > most).any() or (queries < -most).any() or any((w > most).any() or (w < -most).any() for _, w in lists))


def best_of(scores: np.ndarray, query_ids: np.ndarray, vec_ids: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best candidates but itself, ties to smaller ids. ``vec_ids`` is in ascending order."""
    query, vec, score = [], [], []
    firsts, lasts = np.searchsorted(vec_ids, query_ids), np.searchsorted(vec_ids, query_ids, side="right")
    for i, row in enumerate(scores):
        at = np.arange(len(row))
        if firsts[i] < lasts[i]:  # the query's own rows, however many, leave before the best are taken
            at = np.delete(at, slice(firsts[i], lasts[i]))
            row_ = row[at]
        else:
            row_ = row
        if len(at) > k:
            least = np.partition(row_, len(row_) - k)[len(row_) - k]
            at = at[row_ >= least]
        at = at[np.lexsort((vec_ids[at], -row[at] if row[at].min(initial=0) > LONG.min else -row[at].astype(object)))][:k]
        query.append(np.full(len(at), query_ids[i]))
        vec.append(vec_ids[at])
        score.append(row[at])
    return pd.DataFrame({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (vec_id, weights) in numbered blocks of at most ``size``: one row per block with ids and weights.

    Blocks are cut within the tasks that read the vectors, so that no row moves to make them;
    their numbers are dense for each task and are told apart by the task's.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"vec_id": [], "weights": []})
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            while len(held) >= size:
                yield one(held[:size])
                held = held[size:]
        if len(held):
            yield one(held)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        rows = matrix(part["weights"])
        low, high = rows.min(initial=0), rows.max(initial=0)
        kind = next(d for d in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(d).min <= low and high <= np.iinfo(d).max)
        return pd.DataFrame({"n": [len(part)], "terms": [rows.shape[1]], "kind": [kind], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "rows": [rows.astype(kind).tobytes()]})

    return vectors.select("vec_id", "weights").mapInPandas(cut, "n long, terms long, kind string, ids binary, rows binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k best among all other rows: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Rows without an id, and vectors null or with null or
    non-finite components, take no part; vectors of different lengths are compared on the
    components both have; an empty vector scores 0. Repeated rows count once each as candidates
    but once as a query; a row with the query's own id is never its candidate.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("e")))
    rows = written(rows.select("vec_id", weights(F.col("e")).alias("weights"), "q"), "weights")
    asked = rows.filter("q").dropDuplicates(["vec_id"]).select("vec_id", "weights")
    # Small blocks cut by tasks would multiply: one number of partitions for all, by the number of queries.
    n_asked = asked.count()
    parts = max(1, -(-n_asked // query_block))
    asked = blocks(asked.repartition(parts), query_block).withColumn("q_block", F.monotonically_increasing_id())
    asked = written(asked.select("q_block", F.col("n").alias("q_n"), F.col("terms").alias("q_terms"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "queries")
    numbers = [r["q_block"] for r in asked.select("q_block").collect()]  # one number for each QUERY_BLOCK queries
    held = blocks(rows.select("vec_id", "weights"), block)
    pairs = held.withColumn("q_block", F.explode(F.array(*[F.lit(b) for b in numbers]).cast("array<long>")))
    width = max(1, len(numbers))
    pairs = pairs.withColumn("part", F.monotonically_increasing_id() % 1009).repartition(max(width, spark.sparkContext.defaultParallelism), "q_block", "part").join(F.broadcast(asked) if width == 1 else asked, "q_block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = np.frombuffer(r.ids, "<i8")
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                lists = postings(np.frombuffer(r.rows, r.kind).reshape(r.n, r.terms)[order].astype(np.int64))
                queries = np.frombuffer(r.q_rows, r.q_kind).reshape(r.q_n, r.q_terms).astype(np.int64)
                q_ids = np.frombuffer(r.q_ids, "<i8")
                for a in range(0, len(queries), TILE):
                    yield best_of(accumulate(queries[a : a + TILE], lists, len(ids)), q_ids[a : a + TILE], ids, k)

    found = pairs.mapInPandas(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for each one whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Line dedup: a sharded minimal perfect hash over the lines that repeat.

Lines are counted by Spark; those in enough documents are *repeated*. Their 64-bit hashes
are dealt to shards, and each shard gets a minimal perfect hash of its own and two
compact arrays: the fingerprint (another hash) and the largest doc_id of each line, beside
the count. Documents probe the arrays: a line whose fingerprint stands at its place is
repeated, any other line isn't in the index.

Below :data:`BROADCAST_BYTES` the shards go to all tasks, and documents are read once
and not moved. Above it, the documents' line hashes go to the shards instead: a task
gets one shard and a bounded share of its probes, so that a line in a third of all documents is
probed by many tasks, and only hashes move, not texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, mapped, table, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Repeated lines in a shard, about.
SHARD_LINES = 1 << 16
BROADCAST_BYTES = 48 << 20
#: Documents whose probes one task gets, about, when the index is too large to broadcast.
SALTS = 64
SHARD = "shard long, n_shards long, n long, seeds binary, slots binary, prints binary, counts binary, last_docs binary"
STRIP = " \t\n\v\f\r"
TO_LOWER = str.maketrans(UPPER, LOWER)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def line_key(line: Column) -> Column:
    """ASCII white space off both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def key_hash(key: Column) -> Column:
    return F.xxhash64(F.lit(1), key)


def key_print(key: Column) -> Column:
    return F.xxhash64(F.lit(2), key)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, print, docs and last_doc of the lines that stand in at least ``min_docs`` documents.

    Each document is counted once by distinct (line, document) rows, so a line in every document
    is summed by many tasks before its sums meet.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).filter(F.col("doc_id").isNotNull() & (F.char_length("key") >= min_chars))
    # Within a document first, without a shuffle of its own: rows of a (line, document) pair meet in the aggregate below.
    keys = keys.select("doc_id", key_hash(F.col("key")).alias("hash"), key_print(F.col("key")).alias("print"))
    once = keys.groupBy("hash", "print", "doc_id").agg(F.lit(1).alias("one"))
    lines = once.groupBy("hash", "print").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc"))
    return lines.filter(F.col("docs") >= min_docs)


def mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A hash of hashes that depends on ``seed``."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: a seed for each bucket of about 4 keys, and which slots were free.

    Buckets, largest first, try seeds until their keys fall on free places of a table a
    quarter larger than the keys; the ranks of the taken slots make the hash minimal.
    """
    n = len(keys)
    n_buckets, size = n // 4 + 1, n + n // 4 + 1
    bucket = (mix(keys, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    seeds, taken = np.zeros(n_buckets, np.uint32), np.zeros(size, bool)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        own = keys[order[starts[b] : starts[b + 1]]]
        if not len(own):
            break
        for first in range(1, 1 << 30, 16):  # sixteen seeds at a time
            tries = (mix(own[None, :], np.arange(first, first + 16)[:, None]) % np.uint64(size)).astype(np.int64)
            good = ~taken[tries].any(1)
            if len(own) > 1:
                s = np.sort(tries, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], taken[tries[k]] = first + k, True
                break
    return seeds, np.cumsum(taken).astype(np.uint32)


class Shard:
    """The arrays of one shard, and how to probe them."""

    def __init__(self, row) -> None:
        self.n = int(row["n"])
        self.seeds, self.slots = np.frombuffer(row["seeds"], "<u4"), np.frombuffer(row["slots"], "<u4")
        self.prints, self.counts, self.last_docs = (np.frombuffer(row[c], "<i8") for c in ("prints", "counts", "last_docs"))

    def places(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seeds[(mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = (mix(keys, seed) % np.uint64(len(self.slots))).astype(np.int64)
        return np.clip(self.slots[slot].astype(np.int64) - 1, 0, self.n - 1)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in the index, and the largest doc_id that holds it."""
        at = self.places(keys)
        return self.prints[at] == prints, self.last_docs[at]


def build_index(lines: DataFrame) -> DataFrame:
    """One row per shard for the rows of :func:`repeated_lines`.

    A key that two lines share (64 bits are equal) keeps one place with the print of the first; the
    chance is below 1e-7 for a billion distinct repeated lines, and prints tell such lines apart.
    """
    n_shards = max(1, -(-lines.count() // SHARD_LINES))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "print"]).drop_duplicates("hash")
        keys = pdf["hash"].to_numpy().view(np.uint64)
        seeds, slots = build_hash(keys)
        shard = {"shard": int(pdf["shard"].iloc[0]), "n_shards": n_shards, "n": len(pdf), "seeds": seeds.tobytes(), "slots": slots.tobytes()}
        at = Shard({**shard, **dict.fromkeys(("prints", "counts", "last_docs"), b"")}).places(keys)
        order = np.argsort(at)
        arrays = {"prints": "print", "counts": "docs", "last_docs": "last_doc"}
        return pd.DataFrame([{**shard, **{k: pdf[c].to_numpy("<i8")[order].tobytes() for k, c in arrays.items()}}])

    shards = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("hash", 32), F.lit(n_shards)))
    return shards.groupBy("shard").applyInPandas(build, SHARD)


def _drops(keys: np.ndarray, prints: np.ndarray, doc_ids: np.ndarray, shards: dict[int, Shard], n_shards: int) -> np.ndarray:
    """Which of the lines go: repeated ones outside the last document that holds them. """
    out = np.zeros(len(keys), bool)
    own = ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
    for s in np.unique(own):
        if int(s) in shards:
            rows = np.flatnonzero(own == s)
            found, last = shards[int(s)].probe(keys[rows].view(np.uint64), prints[rows])
            out[rows] = found & (last != doc_ids[rows])
    return out


RESULT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"
#: Stands for a null doc_id within tasks.
NO_ID = int(np.iinfo(np.int64).min)


def _rebuilt(batch: pa.RecordBatch, drops: list[set[int]]) -> pa.RecordBatch:
    """The result's rows for a batch of documents; a column ``rest`` goes with them as it is."""
    texts, kept = batch.column("text").to_pylist(), []
    for text, drop in zip(texts, drops, strict=True):
        kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
    columns = [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pa.array([len(d) for d in drops], pa.int64()), pa.array([hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept], pa.string())]
    names = ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"]
    if "rest" in batch.schema.names:
        columns.append(batch.column("rest"))
        names.append("rest")
    return pa.RecordBatch.from_arrays(columns, names)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, rest: list[str] | None = None) -> DataFrame:
    """Documents without repeated lines but in the last document that holds each.

    Returns one row per row of ``docs``: doc_id, text (kept lines), n_lines (before dropping),
    n_dropped, kept_sha256. A null text is one empty line. A row without a doc_id doesn't count
    as a document and loses all repeated lines. Rows with one doc_id are one document when
    counted; all of them keep the lines of which they are the last. An empty table gives no rows.
    Columns named in ``rest`` go with their rows as the struct ``rest``.
    """
    index = written(build_index(written(repeated_lines(docs, min_chars, min_docs), "lines")), "line-index")
    size = index.select(F.sum(sum((F.octet_length(c) for c in ("seeds", "slots", "prints", "counts", "last_docs")), F.lit(0))).alias("b"), F.max("n_shards").alias("n_shards")).first()
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    key = F.transform(lines, line_key)
    long_enough = F.filter(F.transform(key, lambda k, i: F.struct(i.alias("i"), F.when(F.char_length(k) >= min_chars, k).alias("k"))), lambda s: s["k"].isNotNull())
    more = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), long_enough.alias("keys"), *more)
    rows = rows.select("doc_id", "text", *(["rest"] if rest else []), F.transform("keys", lambda s: s["i"]).alias("at"), F.transform("keys", lambda s: key_hash(s["k"])).alias("hashes"), F.transform("keys", lambda s: key_print(s["k"])).alias("prints"))
    n_shards = size["n_shards"] or 1
    out = _by_broadcast(rows, index, n_shards) if (size["b"] or 0) <= broadcast_bytes else _by_shards(rows, index, n_shards)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _by_broadcast(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([r.asDict() for r in index.toLocalIterator()])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {int(r["shard"]): Shard(r) for r in shared.value}
        for batch in batches:
            counts = batch.column("at").value_lengths().to_numpy()
            at, hashes, prints = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "hashes", "prints"))
            gone = _drops(hashes, prints, np.repeat(batch.column("doc_id").to_numpy(), counts), shards, n_shards)
            ends = np.cumsum(counts)
            yield _rebuilt(batch, [set(at[a:b][gone[a:b]].tolist()) for a, b in zip(ends - counts, ends, strict=True)])

    return mapped(rows, drop, _schema(rows))


def _schema(rows: DataFrame) -> str:
    return RESULT + (f", rest {rows.schema['rest'].dataType.simpleString()}" if "rest" in rows.columns else "")


def _by_shards(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """The same without a broadcast: line hashes go to their shard, a bounded share of them to each task."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")
    probes = rows.select("row", "doc_id", F.explode(F.arrays_zip("at", "hashes", "prints")).alias("p")).select("row", "doc_id", "p.*")
    probes = probes.withColumn("shard", F.pmod(F.shiftrightunsigned("hashes", 32), F.lit(n_shards))).withColumn("salt", F.col("row") % SALTS)
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))

    def probe(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"row": [], "at": []}, dtype="int64")
        found, last = Shard(held.iloc[0]).probe(asked["hashes"].to_numpy(np.int64).view(np.uint64), asked["prints"].to_numpy(np.int64))
        return asked.loc[found & (last != asked["doc_id"].to_numpy()), ["row", "at"]]

    gone = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(probe, "row long, at long")
    gone = gone.groupBy("row").agg(F.collect_list("at").alias("gone"))
    both = rows.drop("at", "hashes", "prints").join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>"))).drop("row")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rebuilt(batch, [set(g) for g in batch.column("gone").to_pylist()])

    return mapped(both, rebuild, _schema(both))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, as a digest."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), rep AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, i, line, rep.key IS NOT NULL AND last_doc <> k.doc_id AS gone FROM k LEFT JOIN rep USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

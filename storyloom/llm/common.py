"""Helpers that the training-data operators share.

Nothing here holds table-sized state: intermediate tables are written as
Parquet below the folder named by ``spark.checkpoint.dir``, which every executor
can read, so that a lost executor never costs more than its own tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")
#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one set, a local session gets a fresh one; a cluster doesn't."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "step", row_bytes: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and is computed once.

    Rows of ``row_bytes`` and more are row groups of their own, about. By itself the writer looks at what it holds after 100 rows
    alone, and a reader takes as many of a row group as it has: all of a task's rows at once, if each has megabytes.
    """
    path = new_folder(df.sparkSession, what)
    groups = {"parquet.block.size": row_bytes, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if row_bytes else {}
    df.write.options(**groups).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text, which decides what is held out."""
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Parts of a sample, by the last bits of a hash. Each is small enough for Spark to keep no more of it than needed in every task.
STRATA = 4


def sample_by_hash(rows: DataFrame, group: str, id_: str, most: int) -> list:
    """At most ``most`` of the distinct ids (long) of each group, as rows (group, id): the smallest hashes of each of :data:`STRATA` parts."""
    own = rows.filter(F.col(id_).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(id_).alias("id"), F.xxhash64(id_).alias("h"))
    rank = F.dense_rank().over(Window.partitionBy("group", F.col("h").bitwiseAND(STRATA - 1)).orderBy("h", "id"))
    return own.withColumn("r", rank).filter(F.col("r") <= most // STRATA).select("group", "id").distinct().orderBy("group", "id").collect()


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What a Python worker remembers from task to task. It remembers one thing: another key's goes first."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


#: Bytes of one Arrow batch of texts, about: a task holds a few of them, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def mapped(docs: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keeps: str = "", rows: int = 512) -> DataFrame:
    """``mapInArrow`` for rows with texts: batches are bounded in bytes, not in rows alone, and memory goes back at the end.

    ``keeps`` is the key of what the worker remembers for this function; all else is forgotten before it begins. The
    function gets at most ``rows`` rows at a time; 0: whole batches.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keeps not in _kept:
            _kept.clear()
        yield from function(part for batch in batches for part in slices_of(batch, rows or max(1, batch.num_rows)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def slices_of(batch, rows: int = 512) -> Iterator:
    """A record batch in parts, so that few texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def chunks_of(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``chars`` characters each, at least one text."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def without_hashes(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't among those of ``gone``, by two of its hashes (hash, print); all columns as they are.

    A table of bits tells which rows might go; only those are moved, to be held against the hashes themselves.
    """
    from .sketch import might_hold, sketch_of

    gone = written(gone.select(F.col("hash").alias("gone hash"), F.col("print").alias("gone print")), "gone")
    bits = docs.sparkSession.sparkContext.broadcast(sketch_of(gone.select(F.col("gone hash").alias("hash"))))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.xxhash64(key).alias("hash of the key"))

    def part(doubtful: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns - 1
                yield batch.filter(pa.array(might_hold(bits.value, batch.column(n).to_numpy()) == doubtful)).select(list(range(n)))

        return mapped(rows, keep, docs.schema)

    held = part(True)
    return part(False).unionByName(held.join(gone, (F.xxhash64(key) == F.col("gone hash")) & (F.xxhash64(F.lit(1), key) == F.col("gone print")), "left_anti"))

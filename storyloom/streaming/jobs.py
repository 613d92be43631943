"""Structured Streaming forms of the pipeline's cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables as s


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table of the test data as a stream of its files."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if _is_file(batch) else reader.parquet(f"{sf_dir}/{name}.parquet")


def _is_file(batch: DataFrame) -> bool:
    """Whether the table is one file: its only file's name is the table's."""
    files = batch.inputFiles()
    return len(files) == 1 and files[0].split("/")[-1].count("part-") == 0


def drain(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], processing_time: str | None = None):
    """Run a stream's batches through ``each``: all that is there once, or for ever at an interval."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", s.new_path(stream.sparkSession, f"{name}-log"))
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def deduplicated(stream: DataFrame, keys: list[str], path: str, at: str = "ts", late: str | None = None) -> None:
    """First rows of each key, held against the stored table.

    ``late`` is for live sources: the stream's state knows the keys within that watermark, and rows behind it are dropped. The
    files of a stored table come in any order, so that without it no row is too late.
    """
    rows = stream.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).select(*keys).distinct()
        except Exception as error:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        new = batch.dropDuplicates(keys)
        (new if known is None else new.join(known, keys, "left_anti")).write.mode("append").parquet(path)

    drain(rows, "dedupe", append)


def windowed(stream: DataFrame, out: str, size: str = "1 hour", late: str | None = None) -> None:
    """Counts of tumbling windows: of each batch, to be added up.

    With ``late``, for live sources, they are updated while their watermark is open, and the last update of a window counts.
    """
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    if not late:

        def add(batch: DataFrame, number: int) -> None:
            counts = batch.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
            counts.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

        drain(rows, "windows", add)
        return
    rows = rows.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))

    def append(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n", F.lit(number).alias("batch")).write.mode("append").parquet(out)

    writer = counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", s.new_path(stream.sparkSession, "windows-log"))
    writer.trigger(availableNow=True).start().awaitTermination()


def silences(stream: DataFrame, key: str, out: str, gap: str, at: str = "ts", late: str | None = None) -> None:
    """States of ``key`` (start, last, n) that end when the key is silent for longer than ``gap``.

    With ``late``, for live sources, the stream keeps the open states, and writes each once its key has been silent and the watermark has
    passed. The files of a stored table come in any order: then each batch writes its own pieces, and :func:`joined_pieces` puts them together.
    """
    rows = stream.withColumn(at, F.col(at).cast("timestamp"))

    def states(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n"))
        return counts.select(key, "start", "last", "n")

    def write(batch: DataFrame, number: int) -> None:
        (batch if late else states(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(states(rows.withWatermark(at, late)) if late else rows, "silences", write)


def joined_pieces(pieces: DataFrame, key: str, gap: str) -> DataFrame:
    """Pieces of a key's states that lie within ``gap`` of one another as one state each."""
    order = Window.partitionBy(key).orderBy("start", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") >= before + F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    rows = pieces.withColumn("new", new).withColumn("state", F.sum("new").over(order))
    return rows.groupBy(key, "state").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("state")

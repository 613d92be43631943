"""Folders that executors share, and tables written once; tables that change are in versions.py."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Without one set, a local session gets a fresh one; a cluster doesn't."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_once: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is derived from the tables in ``d`` and read by many queries: written by the first query of a session that needs it."""
    key = spark.sparkContext.applicationId, d, name
    if key not in _once or not exists(spark, _once[key][0]):
        df = make()
        path = new_path(spark, name)
        df.write.parquet(path)
        _once[key] = path, df.schema
    path, schema = _once[key]
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def append_articles(rows: DataFrame, path: str) -> None:
    """Articles added to a table that is partitioned by day; ids are hashes, the same in every run."""
    rows = rows.withColumn("article_key", F.xxhash64("dedupe_hash")).withColumn("day", F.to_date("published_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)

"""The corpus pipeline: five stages, each one of the training-data operators.

Each stage takes what its predecessor kept and decides on that alone; all but the last return the
columns of ``documents``. Rows without a doc_id pass the stages like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table, written
from storyloom.llm.decontaminate import without_leaks
from storyloom.llm.language import held_out, in_a_language, learned
from storyloom.llm.line_dedup import dedup_lines
from storyloom.llm.minhash import without_near_duplicates
from storyloom.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled rows; texts without a letter go."""
    return in_a_language(docs, learned(docs, ~held_out(F.col("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat; n_chars is counted anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    lines = dedup_lines(docs, rest=others)
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return lines.select(*(columns[c].alias(c) if c in columns else F.col("rest").getField(c).alias(c) for c in docs.columns))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on 5-word shingles: the one with the smallest doc_id."""
    return without_near_duplicates(docs, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a training sequence for each piece of the documents that are left."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisers and trained models have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

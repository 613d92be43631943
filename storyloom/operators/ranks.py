"""Ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: The lower bits of a row's number are its place in its partition.
PLACE = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank from 1 in ``order``, which leaves no two rows equal (else these come in any order).

    Rows are spread by ranges of the order and sorted within; a row's rank is its place in its part and the number of rows
    in the parts before it. Only the parts' counts, a row each, are added up in one task.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(spread.withColumn("number of the row", F.monotonically_increasing_id()), "ranks")
    part, place = F.shiftright("number of the row", 33), F.col("number of the row").bitwiseAND(PLACE)
    counts = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", earlier.alias("earlier"))  # a row for each part
    numbered = parts.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn(name, place + F.col("earlier") + 1).drop("part", "earlier", "number of the row")

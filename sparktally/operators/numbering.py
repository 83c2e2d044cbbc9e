"""Row numbers over a whole table without a window over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Where monotonically_increasing_id() keeps the partition.
SHIFT = 33


def numbered(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``df`` with its place by ``order``, from 0, as ``name``; equal rows in any order, nulls first.

    Ranges of the order are sorted each by itself and written, so that their numbers stand; the counts of the ranges, one
    row each, are then summed up. Sparse or crowded keys make no difference. No rows: none.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", SHIFT), "_own": F.col("_at").bitwiseAND(F.lit((1 << SHIFT) - 1))}).drop("_at")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("_part", before.alias("_first"))), "_part").withColumn(name, F.col("_first") + F.col("_own")).drop("_part", "_own", "_first")

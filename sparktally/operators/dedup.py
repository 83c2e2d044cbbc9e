"""Row choice by key: keep the last, prefer by priority, merge shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in ``order``, which should be total. Spark keeps one row of a key in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def by_priority(levels: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Merges ``levels``, the most trusted first: within a level the first row in ``order`` wins, and an earlier level any later one."""
    united = None
    for n, df in enumerate(levels):
        df = df.withColumn("_level", F.lit(n))
        united = df if united is None else united.unionByName(df)
    return keep_first(united, keys, F.col("_level"), *order).drop("_level")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``base`` with the rows of ``changes`` put in by key; of several changes to a key the first in ``order`` counts."""
    latest = keep_first(changes, keys, *order)
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(base.columns))

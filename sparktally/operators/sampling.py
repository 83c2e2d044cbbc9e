"""Choices by hash: the same in every run and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """A key's bucket from the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % buckets


def k_of_each(df: DataFrame, keys: list[str], k: int, ident: str, salt: str = "") -> DataFrame:
    """k rows of each group without replacement, all of a smaller one, in hashed order; tasks cut their rows to k first."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(salt), F.col(ident).cast("string"))), ident)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder the cluster shares; one of our own where none is set, as in tests."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: each node's greater neighbours go to its least; small: its lesser ones do, and itself.

    The least neighbour comes from a partial aggregate and a join, so that a hub's edges are never gathered in one task.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (a, b) of one orderable type to (node, component): the least node that each node reaches.

    Null ends and self-loops link nothing; a node that occurs in self-loops only is not returned. Repeated and
    reversed edges count once. No edges: no rows. Rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    sign = None
    for _ in range(max_rounds):
        now = checkpointed(_star(_star(now, large=True), large=False))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()

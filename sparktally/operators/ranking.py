"""Ordered analytics: ranked metrics, cumulative sums that don't need one task, runs, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_levels(df: DataFrame, keys: list[str], score: str, hit: Column) -> DataFrame:
    """(keys, score, tp, fp): hits and misses by class and score. The ranked metrics run on these, not on all detections."""
    return df.groupBy(*keys, score).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))


def precision_recall(levels: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Adds cumulative precision and recall from the highest score down, and ``envelope``: the best precision at this recall or more."""
    down = Window.partitionBy(*keys).orderBy(F.desc(score))
    hits = F.sum("tp").over(down.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum(F.col("tp") + F.col("fp")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    npos = F.sum("tp").over(Window.partitionBy(*keys))
    out = levels.withColumns({"hits": hits, "npos": npos, "precision": hits / all_}).withColumn("recall", F.try_divide("hits", "npos"))
    # the running maximum from the lowest score up: one pass, where a frame to the end would be read again for each row
    up = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("envelope", F.max("precision").over(up))


def average_precision(curve: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Area under the envelope: each step of recall times the precision there. Null for a class without positives."""
    step = F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy(*keys).orderBy(F.desc(score))), F.lit(0.0))
    return curve.withColumn("_part", step * F.col("envelope")).groupBy(*keys).agg(F.max("npos").alias("npos"), F.sum("_part").alias("ap"))


def precision_at_recalls(curve: DataFrame, keys: list[str], points: list[float]) -> DataFrame:
    """(keys, point, precision): the envelope at the first level whose recall reaches each point, else 0."""
    reached = [F.coalesce(F.max(F.when(F.col("recall") >= p, F.col("precision"))), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(points)]
    wide = curve.groupBy(*keys).agg(*reached)
    pairs = F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"p{i}").alias("precision")) for i, p in enumerate(points)])
    return wide.select(*keys, F.inline(pairs))


def top_k(df: DataFrame, keys: list[str], k: int | Column, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def islands(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Numbers the runs of equal ``label`` within each key: a new run begins where the label differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

"""Suppression and voting among any number of boxes, as joins in rounds: no group of boxes is gathered in one row or task.

Boxes are rows with the columns ``by`` (what keeps groups apart), ``rank`` (orderable and unique in a group; the least is the best)
and x1, y1, x2, y2. Rows with a null rank or coordinate take part in nothing. ``pixel`` is 1 where boxes count their last
pixel. A box goes if its overlap with a better box that stays is ``least`` or more (``strict``: more than that); ``least`` is above 0.

Two boxes with an overlap of at least ``least`` are of similar size, so a box lies on grids of its own size and of the few next
larger ones, in at most four cells of each; boxes that clash share a cell. Groups of at most ``few`` boxes need neither grids nor rounds:
they are gone through best first, each as one array.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_CEILING, Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .graph import checkpointed
from .space import crowded, flat, gathered, parted

BOX = ("x1", "y1", "x2", "y2")


def overlap(a: str, b: str, pixel: float) -> Column:
    """Intersection over union of the boxes in the columns with prefixes ``a`` and ``b``; 0 for two boxes without area."""
    side = lambda p, q, lo, hi: F.least(F.col(p + hi), F.col(q + hi)) - F.greatest(F.col(p + lo), F.col(q + lo)) + pixel
    both = F.greatest(F.lit(0.0), side(a, b, "x1", "x2")) * F.greatest(F.lit(0.0), side(a, b, "y1", "y2"))
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1") + pixel) * (F.col(p + "y2") - F.col(p + "y1") + pixel)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def clash(a: str, b: str, least: float, pixel: float, strict: bool) -> Column:
    over = F.round(overlap(a, b, pixel), 9)
    return over > least if strict else over >= least


def solid(pixel: float) -> Column:
    """Whether a box has an area; one without overlaps with nothing, not even with its copy."""
    return (F.col("x2") - F.col("x1") + pixel > 0) & (F.col("y2") - F.col("y1") + pixel > 0)


def least_overlap(least: float, strict: bool) -> float:
    """The least overlap that, rounded to nine places, is at least ``least`` (``strict``: more)."""
    nine, at = Decimal("1e-9"), Decimal(repr(float(least)))
    up = at.quantize(nine, ROUND_CEILING)
    return float((up + nine if strict and up == at else up) - nine / 2)


def seeds(box: np.ndarray, over: float, pixel: float) -> tuple[np.ndarray, np.ndarray]:
    """(seed, iou) for each box, best first: the place of the first box that stays and overlaps by ``over``, itself if it stays."""
    x1, y1, x2, y2 = box.T
    side = lambda lo, hi: np.maximum(0.0, np.minimum(hi[:, None], hi) - np.maximum(lo[:, None], lo) + pixel)
    area = (x2 - x1 + pixel) * (y2 - y1 + pixel)
    both = side(x1, x2) * side(y1, y2)
    whole = area[:, None] + area - both
    iou = np.divide(both, whole, out=np.zeros_like(both), where=whole != 0)
    clash, seed = iou >= over, np.full(len(box), -1, np.int32)
    for i in range(len(box)):
        if seed[i] < 0:
            seed[clash[i] & (seed < 0)] = i
            seed[i] = i
    solid_ = (x2 - x1 + pixel > 0) & (y2 - y1 + pixel > 0)
    return seed, np.where(solid_, iou[seed, np.arange(len(box))], 1.0)


def _seeds(least: float, pixel: float, strict: bool) -> Callable:
    over = least_overlap(least, strict)

    def run(boxes: pd.Series) -> pd.DataFrame:
        found = [(*seeds(b.reshape(-1, 4), over, pixel),) for b in boxes]
        return pd.DataFrame([(s, i, np.bincount(s)[s].astype(np.int32)) for s, i in found], columns=["seed", "iou", "n"])

    return F.pandas_udf(run, StructType().add("seed", ArrayType(IntegerType())).add("iou", ArrayType(DoubleType())).add("n", ArrayType(IntegerType())))


def whole_groups(rows: DataFrame, by: list[str], least: float, pixel: float, strict: bool, keep: list[str]) -> DataFrame:
    """(by, rank, x1.., keep, seed, iou, n, members) of groups of few boxes; n: the boxes of the seed, members: those of the group."""
    g = gathered(rows, by, "boxes", "rank", *BOX, *keep)
    g = g.withColumn("s", _seeds(least, pixel, strict)(flat("boxes", *BOX)))

    def one(x: Column, i: Column) -> Column:
        seed = F.get("boxes", F.get("s.seed", i))["rank"]
        return F.struct(*[x[c].alias(c) for c in ("rank", *BOX, *keep)], seed.alias("seed"), F.round(F.get("s.iou", i), 9).alias("iou"), F.get("s.n", i).cast("long").alias("n"), F.size("boxes").cast("long").alias("members"))

    return g.select(*by, F.inline(F.transform("boxes", one)))


def usable(boxes: DataFrame, by: list[str], keep: list[str] | None = None) -> DataFrame:
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) & ~F.isnan(F.col(c).cast("double")) for c in BOX])
    return boxes.where(ok & F.col("rank").isNotNull()).select(*by, "rank", *[F.col(c).cast("double").alias(c) for c in BOX], *(keep or []))


def gridded(boxes: DataFrame, least: float, pixel: float) -> DataFrame:
    """A row for each cell (level, cx, cy) of a box; boxes without area are on none."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + pixel
    own = F.floor(F.log2(side)).cast("int")
    levels = math.floor(math.log2(1 / least)) + 1
    df = boxes.where(solid(pixel)).withColumn("level", F.explode(F.sequence(own, own + levels)))
    size = F.pow(F.lit(2.0), F.col("level") + 1)
    for c, lo, hi in (("cx", "x1", "x2"), ("cy", "y1", "y2")):
        df = df.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) + pixel) / size))))
    return df


def prefixed(df: DataFrame, prefix: str, kept: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in kept})


def suppress(boxes: DataFrame, by: list[str], least: float, pixel: float = 0.0, strict: bool = False, crowd: int = 64, most: int = 2048, few: int = 512) -> DataFrame:
    """(by, rank) of the boxes that stay when each box, best first, goes if it clashes with one that stays.

    Equal boxes stand for the best of them: the others clash with it (unless ``strict`` with ``least`` 1). While cells hold more than
    ``crowd`` boxes for a box, those that are the best of all their cells stay and take out what they clash with, so that a heap
    of near-copies is never met pair by pair; that ends early if it takes out less than a fifth in a round and cells hold at most
    ``most`` boxes for a box. The pairs left are worked off in rounds: boxes without a better rival stay.
    """
    if not by:
        return suppress(boxes.withColumn("_all", F.lit(0)), ["_all"], least, pixel, strict, crowd, most, few).drop("_all")
    rows = usable(boxes, by)
    large = crowded([(rows, few)], by)
    rows, many = parted(rows, large, by)
    stay = whole_groups(rows, by, least, pixel, strict, []).where(F.col("rank") == F.col("seed")).select(*by, "rank")
    return stay if large is None else stay.unionByName(_in_rounds(many, by, least, pixel, strict, crowd, most))


def _in_rounds(rows: DataFrame, by: list[str], least: float, pixel: float, strict: bool, crowd: int = 64, most: int = 2048) -> DataFrame:
    cell = [*by, "level", "cx", "cy"]
    left = checkpointed(rows.where(solid(pixel)).groupBy(*by, *BOX).agg(F.min("rank").alias("rank")))
    name = [*by, "rank"]
    kept, size, slow = [rows.where(~solid(pixel)).select(*name)], 0, False
    while True:
        cells = gridded(left, least, pixel)
        load = cells.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
        if (load["pairs"] or 0) <= (most if slow else crowd) * (load["n"] or 0):
            break
        best = cells.groupBy(*cell).agg(F.min("rank").alias("best"))
        tops = cells.join(best, cell).groupBy(*name).agg(F.bool_and(F.col("rank") == F.col("best")).alias("top")).where("top").select(*name)
        tops = checkpointed(left.join(tops, name, "left_semi"))
        met = prefixed(cells, "b_", cell).join(prefixed(gridded(tops, least, pixel), "a_", cell), cell).where("a_rank < b_rank").where(clash("a_", "b_", least, pixel, strict))
        gone = met.select(*by, F.col("b_rank").alias("rank")).distinct()
        kept.append(tops.select(*name))
        left = checkpointed(left.join(tops, name, "left_anti").join(gone, name, "left_anti"))
        size, slow = load["n"], bool(size) and load["n"] > 0.8 * size
    cells = gridded(left, least, pixel)
    pairs = prefixed(cells, "a_", cell).join(prefixed(cells, "b_", cell), cell).where("a_rank < b_rank").where(clash("a_", "b_", least, pixel, strict))
    edges, out = checkpointed(pairs.select(*by, "a_rank", "b_rank").distinct()), []
    while not edges.isEmpty():
        better, worse = [*by, "a_rank"], [*by, "b_rank"]
        free = edges.select(*better).join(edges.select(*by, F.col("b_rank").alias("a_rank")), better, "left_anti").distinct()
        gone = checkpointed(edges.join(free, better, "left_semi").select(*worse).distinct())
        out.append(gone.select(*by, F.col("b_rank").alias("rank")))
        edges = checkpointed(edges.join(gone, worse, "left_anti").join(gone.select(*by, F.col("b_rank").alias("a_rank")), better, "left_anti"))
    stay = left.select(*name)
    if out:
        stay = stay.join(reduce(DataFrame.unionByName, out), name, "left_anti")
    stay = reduce(DataFrame.unionByName, [stay, *kept])
    if strict and least >= 1:  # equal boxes don't clash then
        return rows.select(*name)
    return stay


def clusters(boxes: DataFrame, by: list[str], least: float, pixel: float = 1.0, few: int = 512) -> DataFrame:
    """(by, rank, seed, iou): each box with the best box that stays (its seed) and clashes with it, itself if it stays."""
    if not by:
        return clusters(boxes.withColumn("_all", F.lit(0)), ["_all"], least, pixel, few).drop("_all")
    return _clusters(boxes, by, least, pixel, few, []).select(*by, "rank", *BOX, "seed", "iou")


def _clusters(boxes: DataFrame, by: list[str], least: float, pixel: float, few: int, keep: list[str]) -> DataFrame:
    """clusters() with the columns ``keep``, n (the boxes of the seed) and members (those of the group)."""
    rows = usable(boxes, by, keep)
    large = crowded([(rows, few)], by)
    rows, many = parted(rows, large, by)
    found = whole_groups(rows, by, least, pixel, False, keep)
    return found if large is None else found.unionByName(_clusters_of_many(many, by, least, pixel, keep))


def _clusters_of_many(rows: DataFrame, by: list[str], least: float, pixel: float, keep: list[str]) -> DataFrame:
    cell = [*by, "level", "cx", "cy"]
    seeds_ = rows.join(_in_rounds(rows.select(*by, "rank", *BOX), by, least, pixel, False), [*by, "rank"], "left_semi").select(*by, "rank", *BOX)
    # the distinct boxes meet the seeds; equal boxes share what they find
    plain = rows.select(*by, *BOX).distinct()
    met = prefixed(gridded(plain, least, pixel), "b_", cell).join(prefixed(gridded(seeds_, least, pixel), "a_", cell), cell)
    met = met.where(clash("a_", "b_", least, pixel, False)).select(*by, *[F.col(f"b_{c}").alias(c) for c in BOX], F.struct(F.col("a_rank").alias("seed"), F.round(overlap("a_", "b_", pixel), 9).alias("iou")).alias("s"))
    found = met.groupBy(*by, *BOX).agg(F.min("s").alias("s"))
    # a seed without area is on no grid
    out = rows.join(found, [*by, *BOX], "left").select(*by, "rank", *BOX, *keep, F.coalesce("s.seed", "rank").alias("seed"), F.coalesce("s.iou", F.lit(1.0)).alias("iou"))
    out = checkpointed(out)
    sizes = out.groupBy(*by, "seed").agg(F.count("*").alias("n"))
    return out.join(sizes, [*by, "seed"]).join(sizes.groupBy(*by).agg(F.sum("n").alias("members")), by)


def vote(boxes: DataFrame, by: list[str], least: float, pixel: float = 1.0, soft: float | None = None, few: int = 512) -> DataFrame:
    """(by, seed, rank, n, x1, y1, x2, y2, score): clusters as their score-weighted mean box with their best score.

    ``boxes`` has a column score besides. Clusters of several boxes with ``soft``: their members too, by score * (1 - overlap with the seed) where that
    is at least ``soft``; rank names the member then, and is null for a cluster's own row. A group of a single box gives no row, as it has
    nothing to vote with. Scores of a sum of zero give the seed's own box.
    """
    if not by:
        return vote(boxes.withColumn("_all", F.lit(0)), ["_all"], least, pixel, soft, few).drop("_all")
    found = _clusters(boxes, by, least, pixel, few, ["score"]).where("members > 1")
    # a member is also a row of its own, so that the boxes are gone through once
    none = F.lit(None).cast(found.schema["rank"].dataType)
    left = F.col("score") * (1 - F.col("iou"))
    if soft is None:
        found = found.withColumns({"member": none, "left": F.col("score")})
    else:
        kept = F.when((F.col("n") > 1) & (left >= soft), F.array(none, F.col("rank"))).otherwise(F.array(none))
        found = found.withColumns({"left": left, "member": F.explode(kept)})
    total, own, alone = F.sum("score"), F.col("rank") == F.col("seed"), F.col("member").isNotNull()
    mean = [F.when(alone, F.max(c)).otherwise(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("score")), total), F.max(F.when(own, F.col(c))))).alias(c) for c in BOX]
    out = found.groupBy(*by, "seed", "member").agg(F.max("n").alias("n"), *mean, F.when(alone, F.max("left")).otherwise(F.max("score")).alias("score"))
    return out.select(*by, "seed", F.col("member").alias("rank"), "n", *BOX, "score")

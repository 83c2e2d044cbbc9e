"""Connected pixels of masks, in tiles: any mask size, no mask in one task.

A tile's pixels are gathered as one set of small numbers and labelled by runs (stretches of pixels in a line); runs that
touch across a tile's border link the tiles' labels, and connected_components() joins those. Pixels touch by sides and
corners. A component is named by its first pixel, by line, then column. Rows with a null mask, x or y are no pixels; repeated
pixels count once; coordinates may be negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, connected_components

TILE = 128
RUN = "y long, x0 long, x1 long, ly long, lx long"


def label_tile(pixels: np.ndarray) -> np.ndarray:
    """(y, x0, x1, ly, lx) of each run of a boolean tile, in order; x1 is the first column after it, ly and lx its component's first pixel."""
    edge = np.diff(np.pad(pixels, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    line = np.searchsorted(y, np.arange(len(pixels) + 1)).tolist()
    a, b = x0.tolist(), x1.tolist()
    for k in range(1, len(pixels)):
        i, j, last, end = line[k - 1], line[k], line[k], line[k + 1]
        while i < last and j < end:
            if a[i] <= b[j] and a[j] <= b[i]:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    first = np.array([find(i) for i in range(len(y))], int)
    return np.stack([y, x0, x1, y[first], x0[first]], axis=1) if len(y) else np.zeros((0, 5), int)


def _tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(mask, tx, ty, own): the pixels of each tile as numbers below tile * tile; the sets are partial by task."""
    at = pixels.where("mask is not null and x is not null and y is not null").select("mask", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    own = (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile))).cast("int")
    return at.groupBy("mask", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.collect_set(own).alias("own"))


def _labelled(tiles: DataFrame, tile: int, holes: bool, most: int = 1 << 15) -> DataFrame:
    """The runs of each tile; ``holes``: those of what isn't in the mask, within width and height.

    A task holds the runs of ``most`` and a tile at a time, however many tiles come in one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, held = [], 0
            for i, row in enumerate(pdf.itertuples(index=False)):
                pixels = np.zeros(tile * tile, bool)
                if row.own is not None:
                    pixels[row.own] = True
                pixels = pixels.reshape(tile, tile)
                if holes:
                    pixels = ~pixels
                    pixels[max(0, row.height - row.ty * tile) :], pixels[:, max(0, row.width - row.tx * tile) :] = False, False
                runs = label_tile(pixels) + np.array([row.ty, row.tx, row.tx, row.ty, row.tx]) * tile
                found.append((i, runs))
                held += len(runs)
                if held > most:
                    yield table(pdf, found)
                    found, held = [], 0
            if found:
                yield table(pdf, found)

    def table(pdf: pd.DataFrame, found: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        at = np.repeat([i for i, _ in found], [len(runs) for _, runs in found])
        out = pd.DataFrame(np.concatenate([runs for _, runs in found]), columns=["y", "x0", "x1", "ly", "lx"])
        out.insert(0, "tx", pdf["tx"].to_numpy()[at])
        out.insert(0, "mask", pdf["mask"].iloc[at].reset_index(drop=True))
        return out

    kind = tiles.schema["mask"].dataType.simpleString()
    return tiles.mapInPandas(run, f"mask {kind}, tx long, {RUN}")


def _joined(runs: DataFrame, tile: int) -> DataFrame:
    """(mask, y, x0, x1, cy, cx, area): each run with its component across tiles and the component's pixels."""
    runs = checkpointed(runs)
    label = F.struct("mask", "ly", "lx")
    right = runs.where(F.pmod("x1", F.lit(tile)) == 0).select("mask", F.col("x1").alias("x"), F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), label.alias("a"))
    left = runs.where(F.pmod("x0", F.lit(tile)) == 0).select("mask", F.col("x0").alias("x"), "y", label.alias("b"))
    above = runs.where(F.pmod(F.col("y") + 1, F.lit(tile)) == 0).select("mask", "tx", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), label.alias("a"))
    below = runs.where(F.pmod("y", F.lit(tile)) == 0).select("mask", "tx", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), label.alias("b"))
    links = right.join(left, ["mask", "x", "y"]).select("a", "b").union(above.join(below, ["mask", "tx", "y"]).where("a0 <= b1 and b0 <= a1").select("a", "b"))
    whole = connected_components(links)
    runs = runs.withColumn("node", label).join(whole, "node", "left").withColumn("c", F.coalesce("component", "node"))
    # a component's first pixel is the least of its tiles' first ones, as they compare by line, then column
    areas = runs.groupBy("c").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return runs.join(areas, "c").select("mask", "y", "x0", "x1", F.col("c.ly").alias("cy"), F.col("c.lx").alias("cx"), "area")


def components(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(mask, y, x0, x1, cy, cx, area) of each run of the masks' ``pixels`` (mask, x, y). No pixels: no rows."""
    return _joined(_labelled(_tiles(pixels, tile), tile, False), tile)


def outside(pixels: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """The same for what isn't in the masks, within their ``sizes`` (mask, width, height), one row a mask; pixels beyond a size don't matter."""
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / tile)))
    tiles = sizes.where("width > 0 and height > 0").select("mask", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    tiles = tiles.withColumn("tx", upto("width")).withColumn("ty", upto("height"))
    return _joined(_labelled(tiles.join(_tiles(pixels, tile), ["mask", "tx", "ty"], "left"), tile, True), tile)


def _by_component(runs: DataFrame) -> DataFrame:
    return runs.select("mask", "cy", "cx", "area").distinct()


def keep_largest(runs: DataFrame) -> DataFrame:
    """The runs of each mask's largest component; of equal ones the first."""
    best = _by_component(runs).groupBy("mask").agg(F.max(F.struct("area", (-F.col("cy")).alias("y"), (-F.col("cx")).alias("x"))).alias("b"))
    return runs.join(best.select("mask", (-F.col("b.y")).alias("cy"), (-F.col("b.x")).alias("cx")), ["mask", "cy", "cx"], "left_semi")


def drop_smallest(runs: DataFrame) -> DataFrame:
    """The runs without those of each mask's smallest component, of equal ones the first; a single component stays."""
    least = _by_component(runs).groupBy("mask").agg(F.min(F.struct("area", "cy", "cx")).alias("b"), F.count("*").alias("n")).where("n > 1")
    return runs.join(least.select("mask", "b.cy", "b.cx"), ["mask", "cy", "cx"], "left_anti")


def drop_islands(runs: DataFrame, least: int) -> DataFrame:
    """The runs of components of at least so many pixels; of a mask that has none, its largest component."""
    big = runs.where(F.col("area") >= least)
    return big.unionByName(keep_largest(runs.join(big.select("mask").distinct(), "mask", "left_anti")))


def fill_holes(pixels: DataFrame, sizes: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """(mask, y, x0, x1): the runs that fill each mask's holes, those outside it with fewer pixels; a margin counts as a hole too."""
    return outside(pixels, sizes, tile).where(F.col("area") < least).select("mask", "y", "x0", "x1")


def pixels_of(runs: DataFrame) -> DataFrame:
    """(mask, x, y) of each pixel of the runs."""
    return runs.select("mask", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y")

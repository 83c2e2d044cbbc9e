"""Masks of pixels: a mask is 3,000 orders, each line one pixel of an image of 160 x 200."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from ..session import table
from .catalog import query

WIDTH, HEIGHT, TILE = 160, 200, 32
PIXELS = f"p AS (SELECT DISTINCT l_orderkey // 3000 AS mask, l_partkey % {WIDTH} AS x, (l_suppkey * 13 + l_orderkey) % {HEIGHT} AS y FROM lineitem)"


def labelled(source: str) -> str:
    """Each pixel with the first pixel (as line * 1000 + column) that it reaches, by rounds over the neighbours."""
    return f"""q AS MATERIALIZED (SELECT mask, x, y, y * 1000 + x AS spot FROM {source}),
    e AS MATERIALIZED (SELECT a.mask, a.spot AS a, b.spot AS b FROM (SELECT mask, spot, spot + unnest([-1001, -1000, -999, -1, 1, 999, 1000, 1001]) AS near FROM q) a JOIN q b ON b.mask = a.mask AND b.spot = a.near),
    c(mask, spot, first) USING KEY (mask, spot) AS (SELECT mask, spot, spot FROM q UNION (SELECT e.mask, e.a, min(c.first) FROM c JOIN e ON e.mask = c.mask AND e.b = c.spot JOIN recurring.c u ON u.mask = e.mask AND u.spot = e.a WHERE c.first < u.first GROUP BY e.mask, e.a)),
    s AS (SELECT mask, first, count(*) AS area FROM c GROUP BY ALL)"""


BACK = "c.mask, c.spot % 1000 AS x, c.spot // 1000 AS y"


def mask_pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey div 3000 AS mask", f"l_partkey % {WIDTH} AS x", f"(l_suppkey * 13 + l_orderkey) % {HEIGHT} AS y")


@query(f"WITH RECURSIVE {PIXELS}, {labelled('p')} SELECT mask, first // 1000 AS cy, first % 1000 AS cx, CAST(area AS BIGINT) AS area FROM s")
def q_mask_components(spark: SparkSession, d: str) -> DataFrame:
    """The connected parts of each mask, with their pixels, by their first one."""
    return raster.components(mask_pixels(spark, d), TILE).select("mask", "cy", "cx", "area").distinct()


@query(f"WITH RECURSIVE {PIXELS}, {labelled('p')}, b AS (SELECT mask, first FROM s QUALIFY row_number() OVER (PARTITION BY mask ORDER BY area DESC, first) = 1) SELECT {BACK} FROM c JOIN b ON b.mask = c.mask AND b.first = c.first")
def q_keep_largest_component(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of each mask's largest connected part."""
    return raster.pixels_of(raster.keep_largest(raster.components(mask_pixels(spark, d), TILE)))


@query(f"WITH RECURSIVE {PIXELS}, {labelled('p')}, b AS (SELECT mask, first FROM s QUALIFY row_number() OVER (PARTITION BY mask ORDER BY area, first) = 1 AND count(*) OVER (PARTITION BY mask) > 1) SELECT {BACK} FROM c ANTI JOIN b ON b.mask = c.mask AND b.first = c.first")
def q_drop_smallest_component(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of each mask but those of its smallest connected part."""
    return raster.pixels_of(raster.drop_smallest(raster.components(mask_pixels(spark, d), TILE)))


@query(f"WITH RECURSIVE {PIXELS}, {labelled('p')}, b AS (SELECT mask, first FROM s QUALIFY area >= 12 OR max(area) OVER (PARTITION BY mask) < 12 AND row_number() OVER (PARTITION BY mask ORDER BY area DESC, first) = 1) SELECT {BACK} FROM c JOIN b ON b.mask = c.mask AND b.first = c.first")
def q_drop_islands(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of connected parts of at least twelve pixels; of a mask without any, its largest part."""
    return raster.pixels_of(raster.drop_islands(raster.components(mask_pixels(spark, d), TILE), 12))


NEAR = "[-1001, -1000, -999, -1, 0, 1, 999, 1000, 1001]"


def reached(source: str) -> str:
    """The pixels (spot, b) that each spot of ``source`` reaches in a step more, of spots that reach fewer than four."""
    more = f"SELECT DISTINCT r.mask, r.spot, w.spot AS b FROM (SELECT mask, spot, b + unnest({NEAR}) AS near FROM {source}) r JOIN w ON w.mask = r.mask AND w.spot = r.near"
    return f"(SELECT * FROM ({more}) QUALIFY count(*) OVER (PARTITION BY mask, spot) < 4)"


# a hole of fewer than four pixels is what three steps reach, and all that they reach
@query(
    f"""WITH {PIXELS}, w AS MATERIALIZED (SELECT mask, y * 1000 + x AS spot FROM (SELECT DISTINCT mask FROM p), range(0, {WIDTH}) a(x), range(0, {HEIGHT}) b(y) EXCEPT SELECT mask, y * 1000 + x FROM p),
    s1 AS (SELECT DISTINCT r.mask, r.spot, w.spot AS b FROM (SELECT mask, spot, spot + unnest({NEAR}) AS near FROM w) r JOIN w ON w.mask = r.mask AND w.spot = r.near), s2 AS (SELECT * FROM s1 QUALIFY count(*) OVER (PARTITION BY mask, spot) < 4),
    s3 AS {reached("s2")}, s4 AS {reached("s3")} SELECT DISTINCT mask, spot % 1000 AS x, spot // 1000 AS y FROM s4 UNION ALL SELECT mask, x, y FROM p"""
)
def q_fill_holes(spark: SparkSession, d: str) -> DataFrame:
    """Each mask's pixels and those of its holes of fewer than four."""
    pixels = mask_pixels(spark, d).distinct()
    sizes = pixels.select("mask").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    return raster.pixels_of(raster.fill_holes(pixels, sizes, 4, TILE)).unionByName(pixels)

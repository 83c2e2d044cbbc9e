"""Suppression across crops and voting by clusters. A line of an order is a box; an image is 100 orders, a line number's remainder its crop.

The SQL goes through the boxes one by one, best first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suppression
from ..session import table
from .catalog import query

LONG = "bigint"
BOX = {"x1": "p % 97", "y1": "s % 89", "x2": "p % 97 + 15 + 4 * line", "y2": "s % 89 + 20 + q % 9"}
ROWS = f"""g AS (SELECT l_orderkey // 100 AS image, l_orderkey * 8 + l_linenumber AS id, l_linenumber AS line, l_linenumber % 3 AS crop, min(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
b AS (SELECT image, id, crop, q AS score, CAST(5000 / (crop * crop + 1) AS BIGINT) AS area, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in BOX.items())} FROM g)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    one = one.selectExpr("l_orderkey div 100 AS image", "l_orderkey * 8 + l_linenumber AS id", "l_linenumber AS line", "l_linenumber % 3 AS crop", "p", "s", "q")
    return one.selectExpr("image", "id", "crop", "q AS score", "CAST(round(5000 / (crop * crop + 1)) AS BIGINT) AS area", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in BOX.items()])


def over(pixel: int) -> str:
    """Intersection over union of a and b."""
    both = f"greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + {pixel}) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + {pixel})"
    size = lambda t: f"({t}.x2 - {t}.x1 + {pixel}) * ({t}.y2 - {t}.y1 + {pixel})"
    return f"round({both} / ({size('a')} + {size('b')} - {both}), 9)"


def greedy(name: str, source: str, by: str, order: str, clash: str) -> str:
    """CTEs that number a group's boxes and keep them one by one; ``{name}`` has the kept ids of each group."""
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {source}),
    {name}_r AS MATERIALIZED (SELECT {', '.join(f'b.{c}' for c in by.split(', '))}, b.k, b.id, coalesce(list(a.id) FILTER (a.id IS NOT NULL), []) AS rivals FROM {name}_n b LEFT JOIN {name}_n a ON {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))} AND a.k < b.k AND {clash} GROUP BY ALL),
    {name}_w AS (SELECT {by}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT {by} FROM {name}_r)
      UNION ALL SELECT {', '.join(f'w.{c}' for c in by.split(', '))}, r.k, CASE WHEN list_has_any(w.kept, r.rivals) THEN w.kept ELSE list_append(w.kept, r.id) END FROM {name}_w w JOIN {name}_r r ON {' AND '.join(f'r.{c} = w.{c}' for c in by.split(', '))} AND r.k = w.k + 1),
    {name} AS MATERIALIZED (SELECT {by}, unnest(arg_max(kept, k)) AS id FROM {name}_w GROUP BY {by})"""


@query(
    f"""WITH RECURSIVE {ROWS}, {greedy("inside", "b", "image, crop", "score DESC, id", over(0) + " > 0.6")}, c AS (SELECT b.* FROM b JOIN inside i ON i.image = b.image AND i.id = b.id),
    {greedy("across", "c", "image", "area, crop, score DESC, id", over(0) + " > 0.5")} SELECT image, id FROM across"""
)
def q_cross_crop_nms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that stay within their crop, by score, and then across an image's crops, where smaller crops go first."""
    b = boxes(spark, d)
    inside = suppression.suppress(b.withColumn("rank", F.struct((-F.col("score")).alias("s"), "id")), ["image", "crop"], 0.6, strict=True)
    rest = b.join(inside.select("image", F.col("rank.id").alias("id")), ["image", "id"], "left_semi")
    across = suppression.suppress(rest.withColumn("rank", F.struct("area", "crop", (-F.col("score")).alias("s"), "id")), ["image"], 0.5, strict=True)
    return across.select("image", "rank.id")


SEEDS = f"""{greedy("seeds", "b", "image, crop", "score DESC, id", over(1) + " >= 0.4")},
    m AS (SELECT b.image, b.crop, b.id, b.score, b.x1, b.y1, b.x2, b.y2, arg_min(a.id, (-a.score, a.id)) AS seed, arg_min({over(1)}, (-a.score, a.id)) AS iou FROM b JOIN seeds s ON s.image = b.image AND s.crop = b.crop JOIN b a ON a.id = s.id AND {over(1)} >= 0.4 GROUP BY ALL),
    u AS (SELECT image, crop, seed, count(*) AS n, sum(x1 * score) / sum(score) AS x1, sum(y1 * score) / sum(score) AS y1, sum(x2 * score) / sum(score) AS x2, sum(y2 * score) / sum(score) AS y2, max(score) AS score FROM m GROUP BY ALL), v AS (SELECT *, sum(n) OVER (PARTITION BY image, crop) AS members FROM u)"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("x1", "y1", "x2", "y2", "score"))


def voted(df: DataFrame) -> DataFrame:
    return df.select("image", "crop", F.col("seed.id").alias("seed"), F.col("rank.id").alias("member"), "n", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")])


@query(f"WITH RECURSIVE {ROWS}, {SEEDS} SELECT image, crop, seed, CAST(NULL AS BIGINT) AS member, n, {ROUNDED} FROM v WHERE members > 1")
def q_cluster_voting(spark: SparkSession, d: str) -> DataFrame:
    """Each box that stays becomes the score-weighted mean of itself and of the boxes that it takes out."""
    b = boxes(spark, d).withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    return voted(suppression.vote(b, ["image", "crop"], 0.4))


@query(
    f"""WITH RECURSIVE {ROWS}, {SEEDS} SELECT image, crop, seed, CAST(NULL AS BIGINT) AS member, n, {ROUNDED} FROM v WHERE members > 1
    UNION ALL SELECT m.image, m.crop, m.seed, m.id, v.n, m.x1, m.y1, m.x2, m.y2, floor(m.score * (1 - iou) * 10000 + 0.5) / 10000 FROM m JOIN v ON v.image = m.image AND v.crop = m.crop AND v.seed = m.seed AND v.n > 1 WHERE m.score * (1 - iou) >= 12"""
)
def q_soft_cluster_voting(spark: SparkSession, d: str) -> DataFrame:
    """The same, and the boxes taken out stay with what their overlap leaves of their score, from 12 on."""
    b = boxes(spark, d).withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    score = F.when(F.col("rank").isNull(), F.col("score")).otherwise(F.floor(F.col("score") * 10000 + 0.5) / 10000)
    return voted(suppression.vote(b, ["image", "crop"], 0.4, soft=12.0).withColumn("score", score))

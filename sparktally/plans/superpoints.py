"""Features of components and of the edges between them. A shape is twenty orders, a line a point, a part's remainder its component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import superpoints
from ..session import dealt, parts_of, table
from .catalog import query

POINTS = """g AS (SELECT l_orderkey // 20 AS shape, l_orderkey * 8 + l_linenumber AS id, min(l_partkey) % 9 AS comp, CAST(min(l_partkey) % 53 AS DOUBLE) AS x, CAST(max(l_suppkey) % 31 AS DOUBLE) AS y, max(l_quantity) AS z FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
#: Centred sums first, then the trigonometric roots of the characteristic polynomial x^3 - t x^2 + m x - d.
FEATURES = """u AS (SELECT shape, comp, x, y, z, count(*) AS n FROM g GROUP BY ALL),
m AS (SELECT shape, comp, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM u GROUP BY ALL),
v AS (SELECT shape, comp, m.n, k, cx, cy, cz, sum((x - cx) * (x - cx)) AS xx, sum((y - cy) * (y - cy)) AS yy, sum((z - cz) * (z - cz)) AS zz, sum((x - cx) * (y - cy)) AS xy, sum((x - cx) * (z - cz)) AS xz, sum((y - cy) * (z - cz)) AS yz FROM u JOIN m USING (shape, comp) GROUP BY ALL),
w AS (SELECT *, xx + yy + zz AS t, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS s, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy AS d FROM v),
a AS (SELECT *, greatest(0, t * t - 3 * s) AS r FROM w),
b AS (SELECT *, CASE WHEN r > 1e-9 THEN acos(greatest(-1, least(1, (2 * t * t * t - 9 * t * s + 27 * d) / (2 * r * sqrt(r))))) / 3 ELSE 0 END AS o FROM a),
c AS (SELECT *, (t + 2 * sqrt(r) * cos(o)) / 3 / greatest(1, k - 1) AS e1, (t + 2 * sqrt(r) * cos(o - 2 * pi() / 3)) / 3 / greatest(1, k - 1) AS e2, (t + 2 * sqrt(r) * cos(o + 2 * pi() / 3)) / 3 / greatest(1, k - 1) AS e3 FROM b),
f AS (SELECT shape, comp, n, cx, cy, cz, CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN sqrt(t / 2) ELSE e1 END AS length, CASE WHEN k > 2 THEN sqrt(greatest(0, e1 * e2) + 1e-10) ELSE 0 END AS surface, CASE WHEN k > 2 THEN sqrt(greatest(0, e1 * e2 * e3) + 1e-10) ELSE 0 END AS volume FROM c)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """A row for each order and line number; a shape's points are in one part, so all that goes by shape needs no further shuffle."""
    line = dealt(table(spark, d, "lineitem").selectExpr("l_orderkey div 20 AS shape", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "shape")
    one = line.groupBy("shape", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    return one.selectExpr("shape", "l_orderkey * 8 + l_linenumber AS id", "p % 9 AS comp", "CAST(p % 53 AS DOUBLE) AS x", "CAST(s % 31 AS DOUBLE) AS y", "q AS z")


@query(f"WITH {POINTS}, {FEATURES} SELECT shape, comp, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz, round(length, 4) AS length, round(surface, 3) AS surface, round(CASE WHEN volume > 0.05 THEN volume ELSE 0 END, 2) AS volume FROM f")
def q_component_features(spark: SparkSession, d: str) -> DataFrame:
    """Size, centre, length, surface and volume of each component; a flat one's volume, below 0.05, is shown as none."""
    f = superpoints.component_features(points(spark, d), ["shape", "comp"])
    volume = F.when(F.col("volume") > 0.05, F.col("volume")).otherwise(0.0)
    return f.select("shape", "comp", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "cz", "length")], F.round("surface", 3).alias("surface"), F.round(volume, 2).alias("volume"))


@query(
    f"""WITH {POINTS}, {FEATURES}, p AS (SELECT *, lead(id) OVER o AS nid, lead(comp) OVER o AS ncomp, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(z) OVER o AS nz FROM g WINDOW o AS (PARTITION BY shape ORDER BY id)),
    e AS (SELECT DISTINCT * FROM (SELECT shape, comp AS source, ncomp AS target, x AS ax, y AS ay, z AS az, nx AS bx, ny AS by_, nz AS bz FROM p WHERE nid IS NOT NULL UNION ALL SELECT shape, ncomp, comp, nx, ny, nz, x, y, z FROM p WHERE nid IS NOT NULL) WHERE source <> target),
    h AS (SELECT *, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)) AS far FROM e),
    j AS (SELECT shape, source, target, count(*) AS n, avg(ax - bx) AS dx, avg(ay - by_) AS dy, stddev_pop(az - bz) AS sz, avg(far) AS norm FROM h WHERE far < 45 GROUP BY ALL)
    SELECT j.shape, source, target, j.n, round(dx, 4) AS dx, round(dy, 4) AS dy, round(sz, 4) AS sz, round(norm, 4) AS norm, round(s.cx - t.cx, 4) AS cx, round(CASE WHEN t.length > 0 THEN s.length / (t.length + 1e-6) END, 4) AS length_ratio, round(s.n / (t.n + 1e-6), 4) AS n_ratio
    FROM j JOIN f s ON s.shape = j.shape AND s.comp = source JOIN f t ON t.shape = j.shape AND t.comp = target"""
)
def q_component_edges(spark: SparkSession, d: str) -> DataFrame:
    """How neighbouring components lie to each other; points are neighbours that follow each other in a shape. No ratio to a length of zero."""
    p = points(spark, d)
    o = Window.partitionBy("shape").orderBy("id")
    pairs = p.withColumns({f"n{c}": F.lead(c).over(o) for c in ("id", "comp", "x", "y", "z")}).where("nid is not null")
    ends = ("ax", "ay", "az", "bx", "by_", "bz")
    way = lambda *names: F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("source", "target", *ends), strict=True)])
    both = F.array(way("comp", "ncomp", "x", "y", "z", "nx", "ny", "nz"), way("ncomp", "comp", "nx", "ny", "nz", "x", "y", "z"))
    edges = pairs.select("shape", F.inline(both))
    # joins go by all of their keys, so they need their own parts
    features = superpoints.component_features(p, ["shape", "comp"]).repartition(parts_of(table(spark, d, "lineitem")), "shape", "comp")
    out = superpoints.edge_features(edges, features, ["shape"], 45.0)
    zero = features.select("shape", F.col("comp").alias("target"), (F.col("length") == 0).alias("flat"))
    out = out.join(zero, ["shape", "target"]).withColumn("length_ratio", F.when(~F.col("flat"), F.col("length_ratio")))
    return out.select("shape", "source", "target", "n", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "sz", "norm", "cx", "length_ratio", "n_ratio")])

"""Samples of point clouds. A cloud is twenty orders, a line a point, its number the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import farthest, space
from ..session import dealt, table
from .catalog import query


def step(rows: str) -> str:
    """The farthest of ``pts`` from ``chosen`` that isn't among them; of equal ones that of the least hash."""
    return f"list_sort(list_transform(list_filter({rows}, lambda p: NOT list_contains(list_transform(chosen, lambda c: c.id), p.id)), lambda p: {{'d': -list_min(list_transform(chosen, lambda c: pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2))), 'h': p.h, 'p': p}}))[1].p"


@query(
    f"""WITH RECURSIVE g AS (SELECT l_orderkey // 20 AS cloud, l_orderkey * 8 + l_linenumber AS id, l_linenumber AS label, min(l_partkey) % 101 AS x, max(l_suppkey) % 83 AS y, CAST(max(l_quantity) AS BIGINT) AS z FROM lineitem GROUP BY ALL),
    s AS (SELECT cloud, label, list({{'h': md5(CAST(id AS VARCHAR)), 'id': id, 'x': x, 'y': y, 'z': z, 'label': label}} ORDER BY md5(CAST(id AS VARCHAR))) AS pts FROM g GROUP BY ALL),
    a AS (SELECT cloud, label, pts, pts[1:1] AS chosen FROM s UNION ALL SELECT cloud, label, pts, list_append(chosen, {step("pts")}) FROM a WHERE len(chosen) < least(3, len(pts))),
    q AS (SELECT cloud, flatten(list(arg ORDER BY label)) AS chosen, flatten(list(pts ORDER BY label)) AS pts FROM (SELECT cloud, label, arg_max(chosen, len(chosen)) AS arg, any_value(pts) AS pts FROM a GROUP BY ALL) GROUP BY cloud),
    f AS (SELECT cloud, pts, CASE WHEN len(chosen) > 18 THEN list_sort(chosen)[1:1] ELSE chosen END AS chosen, CASE WHEN len(chosen) > 18 THEN chosen ELSE pts END AS pool FROM q
      UNION ALL SELECT cloud, pts, list_append(chosen, {step("pool")}), pool FROM f WHERE len(chosen) < least(18, len(pool))),
    e AS (SELECT cloud, unnest(arg_max(chosen, len(chosen))) AS p FROM f GROUP BY cloud) SELECT cloud, p.id AS id, p.label AS label FROM e"""
)
def q_label_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen points of each cloud: three of each label, far from each other, then those farthest from all chosen."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey div 20 AS cloud", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    one = dealt(rows, "cloud").groupBy("cloud", "l_orderkey", "l_linenumber").agg({"l_partkey": "min", "l_suppkey": "max", "l_quantity": "max"})
    points = one.selectExpr("cloud", "l_orderkey * 8 + l_linenumber AS id", "l_linenumber AS label", "`min(l_partkey)` % 101 AS x", "`max(l_suppkey)` % 83 AS y", "`max(l_quantity)` AS z")
    return farthest.label_aware_sample(points, ["cloud"], 18, 3)


#: Two numbers from 0 to 1 for a sample of a mesh.
DRAW = "CAST('0x' || substr(md5(concat_ws('/', CAST(mesh AS VARCHAR), CAST(i AS VARCHAR))), {0}, 8) AS BIGINT) / 4294967296.0"


@query(
    f"""WITH g AS (SELECT l_orderkey // 20 AS mesh, l_orderkey * 8 + l_linenumber AS tri, min(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
    t AS (SELECT mesh, tri, CAST(p % 97 AS DOUBLE) AS ax, CAST(s AS DOUBLE) AS ay, q AS az, CAST(p % 13 + 2 AS DOUBLE) AS ux, CAST(s % 7 AS DOUBLE) AS uy, CAST(q % 5 AS DOUBLE) AS uz, CAST(p % 5 AS DOUBLE) AS vx, CAST(s % 11 + 2 AS DOUBLE) AS vy, CAST(q % 3 + 1 AS DOUBLE) AS vz FROM g),
    w AS (SELECT *, CAST(round(sqrt(pow(uy * vz - uz * vy, 2) + pow(uz * vx - ux * vz, 2) + pow(ux * vy - uy * vx, 2)) / 2 * 1000) AS BIGINT) AS area FROM t),
    c AS (SELECT *, CAST(sum(area) OVER (PARTITION BY mesh ORDER BY tri) - area AS BIGINT) AS lo, CAST(sum(area) OVER (PARTITION BY mesh) AS BIGINT) AS total FROM w),
    n AS (SELECT mesh, any_value(total) AS total, CAST(any_value(total) // 40000 + 1 AS BIGINT) AS n FROM c GROUP BY mesh), j AS (SELECT mesh, n, total, unnest(range(0, n)) AS i FROM n),
    k AS (SELECT c.*, i, sqrt({DRAW.format(1).replace("mesh AS", "j.mesh AS")}) AS r, {DRAW.format(9).replace("mesh AS", "j.mesh AS")} AS h FROM j JOIN c ON c.mesh = j.mesh AND (2 * i + 1) * j.total >= 2 * j.n * lo AND (2 * i + 1) * j.total < 2 * j.n * (lo + area))
    SELECT mesh, i, tri, round(ax + r * (1 - h) * ux + r * h * vx, 5) AS x, round(ay + r * (1 - h) * uy + r * h * vy, 5) AS y, round(az + r * (1 - h) * uz + r * h * vz, 5) AS z FROM k"""
)
def q_surface_sample(spark: SparkSession, d: str) -> DataFrame:
    """Points on the surface of each mesh, as many as its area asks for: evenly spaced along the triangles' areas, each at a
    hashed place in its triangle. Areas count in thousandths, so that a sample's triangle doesn't hang on rounding.
    """
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    corner = {"ax": "p % 97", "ay": "s", "az": "q", "ux": "p % 13 + 2", "uy": "s % 7", "uz": "q % 5", "vx": "p % 5", "vy": "s % 11 + 2", "vz": "q % 3 + 1"}
    t = one.selectExpr("l_orderkey div 20 AS mesh", "l_orderkey * 8 + l_linenumber AS tri", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in corner.items()])
    return space.surface_points(t, ["mesh"], 40.0).selectExpr("mesh", "i", "tri", *[f"round({c}, 5) AS {c}" for c in "xyz"])

"""Rays, surfaces, nearest points and points in boxes. A line of an order is a triangle or a point, an order a ray or a query.

The SQL compares all pairs of a scene and is written apart from the operators' formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import space
from ..session import dealt, table
from .catalog import query

LONG = "bigint"


def lines(spark: SparkSession, d: str, scene: int, deal: bool = False) -> DataFrame:
    """(mesh, tri, p, s, q): one row for each order and line number; ``deal``: dealt by mesh once, for plans that group by mesh alone."""
    rows = table(spark, d, "lineitem").selectExpr(f"l_orderkey div {scene} AS mesh", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows, keys = (dealt(rows, "mesh"), ["mesh", "l_orderkey"]) if deal else (rows, ["l_orderkey"])
    one = rows.groupBy(*keys, "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    return one.selectExpr("mesh" if deal else f"l_orderkey div {scene} AS mesh", "l_orderkey * 8 + l_linenumber AS tri", "l_linenumber AS line", "p", "s", "q")


def lines_sql(scene: int) -> str:
    return f"g AS (SELECT l_orderkey // {scene} AS mesh, l_orderkey * 8 + l_linenumber AS tri, l_linenumber AS line, min(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


#: A triangle of each line: a corner and two edges.
CORNER = {"ax": "p % 97", "ay": "s", "az": "q", "ex": "p % 13 + 2", "ey": "s % 7", "ez": "q % 5", "fx": "p % 5", "fy": "s % 11 + 2", "fz": "q % 3 + 1"}
TRI = f"t AS (SELECT mesh, tri, line, p, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in CORNER.items())} FROM g)"


def triangles(rows: DataFrame) -> DataFrame:
    rows = rows.selectExpr("*", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in CORNER.items()])
    return rows.selectExpr("*", *[f"a{a} + e{a} AS b{a}" for a in "xyz"], *[f"a{a} + f{a} AS c{a}" for a in "xyz"])


RAY = {"ox": "o_custkey % 120 - 10", "oy": "o_orderkey % 110 - 5", "oz": "-10", "dx": "(o_custkey % 7 - 3) / 10", "dy": "(o_orderkey % 5 - 2) / 10", "dz": "1"}


@query(
    f"""WITH {lines_sql(100)}, {TRI}, r AS (SELECT o_orderkey // 100 AS mesh, o_orderkey AS ray, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in RAY.items())} FROM orders),
    m AS (SELECT r.*, tri, ex, ey, ez, fx, fy, fz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz, dy * fz - dz * fy AS hx, dz * fx - dx * fz AS hy, dx * fy - dy * fx AS hz FROM r JOIN t USING (mesh)),
    n AS (SELECT *, ex * hx + ey * hy + ez * hz AS det, sx * hx + sy * hy + sz * hz AS u, sy * ez - sz * ey AS kx, sz * ex - sx * ez AS ky, sx * ey - sy * ex AS kz FROM m),
    h AS (SELECT mesh, ray, tri, round((fx * kx + fy * ky + fz * kz) / det, 9) AS t FROM n WHERE abs(det) > 1e-12 AND u / det >= 0 AND (dx * kx + dy * ky + dz * kz) / det >= 0 AND u / det + (dx * kx + dy * ky + dz * kz) / det <= 1)
    SELECT mesh, ray, tri, t FROM h WHERE t >= 0 QUALIFY row_number() OVER (PARTITION BY mesh, ray ORDER BY t, tri) = 1"""
)
def q_nearest_hit(spark: SparkSession, d: str) -> DataFrame:
    """The first triangle of its mesh that each ray hits, and where on the ray."""
    rays = table(spark, d, "orders").selectExpr("o_orderkey div 100 AS mesh", "o_orderkey AS ray", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in RAY.items()])
    return space.nearest_hits(rays, triangles(lines(spark, d, 100)), ["mesh"], 16.0)


@query(
    f"""WITH {lines_sql(20)}, {TRI}, v AS (SELECT o_orderkey // 20 AS mesh, o_orderkey AS view, (o_orderkey % 5) * 15 AS el, o_orderkey % 12 * 30 AS az FROM orders),
    w AS (SELECT *, 48 + 150 * cos(radians(el)) * cos(radians(az)) AS ox, 50 + 150 * cos(radians(el)) * sin(radians(az)) AS oy, 25 + 150 * sin(radians(el)) AS oz FROM v),
    r AS (SELECT mesh, view, el, az, tri AS want, ox, oy, oz, ax + (ex + fx) / 3 - ox AS dx, ay + (ey + fy) / 3 - oy AS dy, az_ + (ez + fz) / 3 - oz AS dz FROM w JOIN (SELECT *  EXCLUDE (az), az AS az_ FROM t WHERE line <= 2) USING (mesh)),
    m AS (SELECT r.*, t.tri, ex, ey, ez, fx, fy, fz, ox - ax AS sx, oy - ay AS sy, oz - t.az AS sz, dy * fz - dz * fy AS hx, dz * fx - dx * fz AS hy, dx * fy - dy * fx AS hz FROM r JOIN t USING (mesh)),
    n AS (SELECT *, ex * hx + ey * hy + ez * hz AS det, sx * hx + sy * hy + sz * hz AS u, sy * ez - sz * ey AS kx, sz * ex - sx * ez AS ky, sx * ey - sy * ex AS kz FROM m),
    h AS (SELECT mesh, view, want, tri, round((fx * kx + fy * ky + fz * kz) / det, 9) AS t FROM n WHERE abs(det) > 1e-12 AND u / det >= 0 AND (dx * kx + dy * ky + dz * kz) / det >= 0 AND u / det + (dx * kx + dy * ky + dz * kz) / det <= 1),
    f AS (SELECT mesh, view, want, tri FROM h WHERE t >= 0 QUALIFY row_number() OVER (PARTITION BY view, want ORDER BY t, tri) = 1),
    o AS (SELECT r.mesh, r.view, r.el, r.az, CAST(sum(CASE WHEN f.tri IS NULL THEN 2 WHEN f.tri <> r.want THEN 1 ELSE 0 END) AS BIGINT) AS occluded FROM r LEFT JOIN f ON f.view = r.view AND f.want = r.want GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY occluded, el DESC, az, view) AS place FROM o"""
)
def q_occlusion_rank(spark: SparkSession, d: str) -> DataFrame:
    """Views of a mesh from the least occluded: rays from the camera to the middles of its marked triangles.

    A triangle counts one if another is hit first, two if the ray hits nothing; ties go to the higher elevation, then the azimuth.
    """
    t = triangles(lines(spark, d, 20))
    views = table(spark, d, "orders").selectExpr("o_orderkey div 20 AS mesh", "o_orderkey AS view", "(o_orderkey % 5) * 15 AS el", "o_orderkey % 12 * 30 AS az")
    at = views.selectExpr("*", "48 + 150 * cos(radians(el)) * cos(radians(az)) AS ox", "50 + 150 * cos(radians(el)) * sin(radians(az)) AS oy", "25 + 150 * sin(radians(el)) AS oz")
    marked = t.where("line <= 2").selectExpr("mesh", "tri AS want", *[f"a{a} + (e{a} + f{a}) / 3 AS m{a}" for a in "xyz"])
    rays = at.join(marked, "mesh").selectExpr("mesh", "struct(view, want) AS ray", "el", "az", *[f"o{a}" for a in "xyz"], *[f"m{a} - o{a} AS d{a}" for a in "xyz"])
    rays = rays.withColumn("ray", F.struct("ray.view", "ray.want", "el", "az"))
    hits = space.nearest_hits(rays, t, ["mesh"], 16.0, misses=True)
    cost = F.when(F.col("tri").isNull(), 2).when(F.col("tri") != F.col("ray.want"), 1).otherwise(0)
    one = hits.groupBy("mesh", F.col("ray.view").alias("view"), F.col("ray.el").alias("el"), F.col("ray.az").alias("az")).agg(F.sum(cost).alias("occluded"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("mesh").orderBy("occluded", F.desc("el"), "az", "view")).cast(LONG))


SMALL = {"ax": "p % 23", "ay": "s % 19", "az": "q % 17", "bx": "p % 23 + p % 4", "by": "s % 19 + s % 3", "bz": "q % 17 + 1", "cx": "p % 23 + 1", "cy": "s % 19 + q % 4", "cz": "q % 17 + s % 2"}


def segment_sql(a: str, b: str) -> str:
    """Squared distance of point p from the segment."""
    ab = [f"({b}{x} - {a}{x})" for x in "xyz"]
    along = " + ".join(f"(p{x} - {a}{x}) * {e}" for x, e in zip("xyz", ab, strict=True))
    length = " + ".join(f"{e} * {e}" for e in ab)
    t = f"CASE WHEN {length} > 0 THEN greatest(0, least(1, ({along}) / ({length}))) ELSE 0 END"
    return "(" + " + ".join(f"pow({a}{x} + ({t}) * {e} - p{x}, 2)" for x, e in zip("xyz", ab, strict=True)) + ")"


@query(
    f"""WITH {lines_sql(10)}, t AS (SELECT mesh, tri, line, p % 3 AS face, {', '.join(f'CAST({e} AS DOUBLE) AS {c.replace('b', 'u')}' for c, e in SMALL.items())} FROM g),
    c AS (SELECT mesh, tri, 0 AS corner, ax AS px, ay AS py, az AS pz FROM t WHERE line > 3 UNION ALL SELECT mesh, tri, 1, ux, uy, uz FROM t WHERE line > 3 UNION ALL SELECT mesh, tri, 2, cx, cy, cz FROM t WHERE line > 3),
    f AS (SELECT * EXCLUDE (tri), (ux - ax) * (ux - ax) + (uy - ay) * (uy - ay) + (uz - az) * (uz - az) AS bb, (ux - ax) * (cx - ax) + (uy - ay) * (cy - ay) + (uz - az) * (cz - az) AS bc, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) + (cz - az) * (cz - az) AS cc FROM t WHERE line <= 3),
    j AS (SELECT *, (px - ax) * (ux - ax) + (py - ay) * (uy - ay) + (pz - az) * (uz - az) AS pb, (px - ax) * (cx - ax) + (py - ay) * (cy - ay) + (pz - az) * (cz - az) AS pc FROM c JOIN f USING (mesh)),
    w AS (SELECT *, CASE WHEN bb * cc - bc * bc > 1e-9 THEN (cc * pb - bc * pc) / (bb * cc - bc * bc) ELSE -1 END AS v, CASE WHEN bb * cc - bc * bc > 1e-9 THEN (bb * pc - bc * pb) / (bb * cc - bc * bc) ELSE -1 END AS w FROM j),
    n AS (SELECT DISTINCT mesh, face, tri, corner FROM w WHERE round(CASE WHEN v >= 0 AND w >= 0 AND v + w <= 1 THEN {' + '.join(f'pow(a{x} + v * (u{x} - a{x}) + w * (c{x} - a{x}) - p{x}, 2)' for x in 'xyz')} ELSE least({segment_sql('a', 'u')}, {segment_sql('u', 'c')}, {segment_sql('c', 'a')}) END, 9) <= 9)
    SELECT mesh, face, tri FROM n GROUP BY ALL HAVING count(*) = 3"""
)
def q_face_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Triangles that belong to a face: each of their corners lies within 3 of it. The first three lines are the faces' facets."""
    t = lines(spark, d, 10, deal=True).selectExpr("*", "p % 3 AS face", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in SMALL.items()])
    return space.on_faces(t.where("line > 3"), t.where("line <= 3"), ["mesh"], 3.0, 6.0)


@query(
    f"""WITH {lines_sql(500)}, b AS (SELECT mesh AS scene, tri AS id, CAST(p % 211 AS DOUBLE) AS x, CAST(s AS DOUBLE) AS y, q AS z FROM g),
    a AS (SELECT o_orderkey // 500 AS scene, o_orderkey AS qid, CAST(o_custkey % 700 - 250 AS DOUBLE) AS x, CAST(o_orderkey % 150 AS DOUBLE) AS y, CAST(o_custkey % 60 AS DOUBLE) AS z FROM orders)
    SELECT scene, qid, id, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), 9) AS d2 FROM a JOIN b USING (scene) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, id) = 1"""
)
def q_nearest_point(spark: SparkSession, d: str) -> DataFrame:
    """The point of its scene that is nearest to each query; many queries lie far from all points."""
    base = lines(spark, d, 500).selectExpr("mesh AS scene", "tri AS id", "CAST(p % 211 AS DOUBLE) AS x", "CAST(s AS DOUBLE) AS y", "q AS z")
    asked = table(spark, d, "orders").selectExpr("o_orderkey div 500 AS scene", "o_orderkey AS qid", "CAST(o_custkey % 700 - 250 AS DOUBLE) AS x", "CAST(o_orderkey % 150 AS DOUBLE) AS y", "CAST(o_custkey % 60 AS DOUBLE) AS z")
    return space.nearest_point(asked, base, ["scene"], 8.0)


@query(
    f"""WITH {lines_sql(50)}, b AS (SELECT mesh AS shape, p % 60 AS part, tri AS id, CAST(p % 211 AS DOUBLE) AS x, CAST(s AS DOUBLE) AS y, q AS z FROM g),
    n AS (SELECT *, count(*) OVER (PARTITION BY shape, part) AS n FROM b), f AS (SELECT * FROM n WHERE n <= 3 QUALIFY row_number() OVER (PARTITION BY shape, part ORDER BY id) = 1)
    SELECT f.shape, f.part, b.part AS into_part FROM f JOIN n b ON b.shape = f.shape AND b.n > 3 QUALIFY row_number() OVER (PARTITION BY f.shape, f.part ORDER BY round(pow(f.x - b.x, 2) + pow(f.y - b.y, 2) + pow(f.z - b.z, 2), 9), b.id) = 1"""
)
def q_merge_small_components(spark: SparkSession, d: str) -> DataFrame:
    """Each small part of a shape with the large part that has the point nearest to its own first point."""
    points = lines(spark, d, 50).selectExpr("mesh AS shape", "p % 60 AS part", "tri AS id", "CAST(p % 211 AS DOUBLE) AS x", "CAST(s AS DOUBLE) AS y", "q AS z")
    sizes = points.groupBy("shape", "part").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    first = points.join(sizes.where("n <= 3").select("shape", "id"), ["shape", "id"]).withColumn("qid", F.col("id"))
    large = points.join(sizes.where("n > 3").select("shape", "part"), ["shape", "part"])
    near = space.nearest_point(first, large, ["shape"], 8.0).select("shape", "qid", "id")
    return near.join(first.select("shape", "qid", "part"), ["shape", "qid"]).join(large.select("id", F.col("part").alias("into_part")), "id").select("shape", "part", "into_part")


@query(
    """WITH p AS (SELECT l_orderkey // 200 AS view, l_suppkey % 9 AS part, CAST(l_partkey % 101 AS DOUBLE) AS x, l_quantity AS y FROM lineitem),
    b AS (SELECT o_orderkey // 200 AS view, o_orderkey AS box, CAST(o_custkey % 90 AS DOUBLE) AS x1, CAST(o_orderkey % 30 AS DOUBLE) AS y1, CAST(o_custkey % 90 + 10 + o_orderkey % 70 AS DOUBLE) AS x2, CAST(o_orderkey % 30 + 5 + o_custkey % 40 AS DOUBLE) AS y2 FROM orders),
    j AS (SELECT view, box, part, count(*) AS n FROM p JOIN b USING (view) WHERE x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY ALL), s AS (SELECT view, part, count(*) AS seen FROM p GROUP BY ALL), w AS (SELECT view, sum(seen) AS seen FROM s GROUP BY 1),
    f AS (SELECT view, box FROM j JOIN w USING (view) GROUP BY view, box, w.seen HAVING sum(n) < 0.98 * w.seen)
    SELECT view, box, part, n, seen, round(n / seen, 6) AS ratio FROM j JOIN f USING (view, box) JOIN s USING (view, part)"""
)
def q_box_part_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of each part's points lies strictly inside each box of a view; boxes that hold nearly all points are left out."""
    points = table(spark, d, "lineitem").selectExpr("l_orderkey div 200 AS view", "l_suppkey % 9 AS part", "CAST(l_partkey % 101 AS DOUBLE) AS x", "l_quantity AS y")
    boxes = table(spark, d, "orders").selectExpr("o_orderkey div 200 AS view", "o_orderkey AS box", "CAST(o_custkey % 90 AS DOUBLE) AS x1", "CAST(o_orderkey % 30 AS DOUBLE) AS y1", "CAST(o_custkey % 90 + 10 + o_orderkey % 70 AS DOUBLE) AS x2", "CAST(o_orderkey % 30 + 5 + o_custkey % 40 AS DOUBLE) AS y2")
    inside = space.inside_counts(points, boxes, ["view"], 12.0)
    seen = points.groupBy("view", "part").agg(F.count("*").alias("seen"))
    inside = inside.withColumn("in_box", F.sum("n").over(Window.partitionBy("view", "box")))
    seen = seen.withColumn("all", F.sum("seen").over(Window.partitionBy("view")))
    return inside.join(seen, ["view", "part"]).where("in_box < 0.98 * all").select("view", "box", "part", "n", "seen", F.round(F.col("n") / F.col("seen"), 6).alias("ratio"))


@query(
    f"""WITH {lines_sql(20)}, a AS (SELECT mesh, tri, CAST(p % 97 AS DOUBLE) AS x, CAST(s AS DOUBLE) AS y, q AS z, radians(p % 360) AS r, radians(s * 7) AS w, radians(q * 11) AS t FROM g)
    SELECT mesh, tri, round(cos(t) * cos(w) * x + (cos(t) * sin(w) * sin(r) - sin(t) * cos(r)) * y + (cos(t) * sin(w) * cos(r) + sin(t) * sin(r)) * z, 5) AS x,
      round(sin(t) * cos(w) * x + (sin(t) * sin(w) * sin(r) + cos(t) * cos(r)) * y + (sin(t) * sin(w) * cos(r) - cos(t) * sin(r)) * z, 5) AS y, round(-sin(w) * x + cos(w) * sin(r) * y + cos(w) * cos(r) * z, 5) AS z FROM a"""
)
def q_rotate_points(spark: SparkSession, d: str) -> DataFrame:
    """Points turned by three angles of their own, about x, then y, then z."""
    p = lines(spark, d, 20).selectExpr("mesh", "tri", "CAST(p % 97 AS DOUBLE) AS x", "CAST(s AS DOUBLE) AS y", "q AS z", "radians(p % 360) AS r", "radians(s * 7) AS w", "radians(q * 11) AS t")
    x, y, z = space.turned(space.vector(""), F.col("r"), F.col("w"), F.col("t"))
    return p.select("mesh", "tri", *[F.round(c, 5).alias(a) for a, c in zip("xyz", (x, y, z), strict=True)])


@query(
    f"""WITH {lines_sql(50)}, b AS (SELECT mesh AS shape, tri AS id, p % 8 AS patch, CAST(p % 211 AS DOUBLE) AS x, CAST(s AS DOUBLE) AS y, q AS z FROM g),
    c AS (SELECT shape, patch, floor(avg(x)) AS x, floor(avg(y)) AS y, floor(avg(z)) AS z, round(avg(z), 6) AS logit FROM b GROUP BY ALL)
    SELECT b.shape, b.id, c.patch, c.logit FROM b JOIN c ON c.shape = b.shape QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round(pow(b.x - c.x, 2) + pow(b.y - c.y, 2) + pow(b.z - c.z, 2), 9), c.patch) = 1"""
)
def q_nearest_patch(spark: SparkSession, d: str) -> DataFrame:
    """Each point takes the value of the patch whose centre is nearest."""
    points = lines(spark, d, 50).selectExpr("mesh AS shape", "tri AS qid", "p % 8 AS patch", "CAST(p % 211 AS DOUBLE) AS x", "CAST(s AS DOUBLE) AS y", "q AS z")
    patches = points.groupBy("shape", "patch").agg(*[F.floor(F.avg(a)).cast("double").alias(a) for a in "xyz"], F.round(F.avg("z"), 6).alias("logit"))
    near = space.nearest_point(points, patches.withColumnRenamed("patch", "id"), ["shape"], 32.0).select("shape", F.col("qid").alias("id"), F.col("id").alias("patch"))
    return near.join(patches.select("shape", "patch", "logit"), ["shape", "patch"]).select("shape", "id", "patch", "logit")

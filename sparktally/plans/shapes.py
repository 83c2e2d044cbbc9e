"""Boxes, points and cameras row by row, and the joins between them. A line of an order is a box or a point of that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt, table
from .catalog import query

LONG = "bigint"
#: A box of each line, by name; the same text in both dialects.
BOX = {"x1": "CAST(l_partkey % 97 AS DOUBLE)", "y1": "CAST(l_suppkey % 89 AS DOUBLE)", "x2": "CAST(l_partkey % 97 + 5 * l_linenumber AS DOUBLE)", "y2": "CAST(l_suppkey % 89 AS DOUBLE) + l_quantity"}
ID = "l_orderkey AS image, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS qty"
BOXES = f"b AS (SELECT {ID}, {', '.join(f'{e} AS {c}' for c, e in BOX.items())} FROM lineitem)"
KEY = "image, part, supp, line, qty"
#: A point of each line.
POINT = {"px": "CAST(l_partkey % 101 AS DOUBLE) / 10 - 5", "py": "CAST(l_suppkey % 83 AS DOUBLE) / 10 - 4", "pz": "l_quantity / 10"}
POINTS = f"p AS (SELECT {ID}, {', '.join(f'{e} AS {c}' for c, e in POINT.items())} FROM lineitem)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*ID.split(", "), *[f"{e} AS {c}" for c, e in BOX.items()])


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*ID.split(", "), *[f"{e} AS {c}" for c, e in POINT.items()])


def keyed(df: DataFrame, *exprs: str) -> DataFrame:
    return df.selectExpr(*KEY.split(", "), *exprs)


@query(f"WITH {BOXES} SELECT {KEY}, x2 - x1 AS w, y2 - y1 AS h, x2 - x1 + 1 AS w_pixel, y2 - y1 + 1 AS h_pixel, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b")
def q_box_modes(spark: SparkSession, d: str) -> DataFrame:
    """Corners as width and height, without and with the last pixel, and as a centre."""
    return keyed(boxes(spark, d), "x2 - x1 AS w", "y2 - y1 AS h", "x2 - x1 + 1 AS w_pixel", "y2 - y1 + 1 AS h_pixel", "(x1 + x2) / 2 AS cx", "(y1 + y2) / 2 AS cy")


AREA_OK = "(x2 - x1) * (y2 - y1) >= 20 AND (x2 - x1) * (y2 - y1) <= 0.2 * 100 * 40"


@query(f"WITH {BOXES} SELECT {KEY} FROM b WHERE {AREA_OK} AND x2 - x1 >= 8 AND y2 - y1 >= 4")
def q_area_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Masks neither too small nor above a fifth of the image, with both sides of a least size."""
    return keyed(boxes(spark, d).where(AREA_OK).where("x2 - x1 >= 8 and y2 - y1 >= 4"))


@query(f"WITH {BOXES} SELECT image, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY image HAVING bool_or(x2 - x1 > 5 AND y2 - y1 > 1) AND count(*) FILTER (qty > 10) >= 1")
def q_valid_images(spark: SparkSession, d: str) -> DataFrame:
    """Images with an annotation: not all boxes without extent, and at least one visible point."""
    one = boxes(spark, d).groupBy("image").agg(F.count("*").alias("n"), F.bool_or(F.expr("x2 - x1 > 5 and y2 - y1 > 1")).alias("solid"), F.count_if(F.col("qty") > 10).alias("seen"))
    return one.where("solid and seen >= 1").select("image", "n")


#: A crop of 60 x 45 in an image of 180 x 120; the box is in the crop's own coordinates.
CROP_AT = {"x": "part % 3 * 40", "y": "supp % 3 * 30"}


@query(
    f"""WITH {BOXES}, c AS (SELECT {KEY}, [x1, y1, x2, y2] AS box, [0, 0, 60, 45] AS crop, [part % 3 * 40, supp % 3 * 30, part % 3 * 40, supp % 3 * 30] AS shift, [0, 0, 180, 120] AS whole FROM b)
    SELECT {KEY} FROM c WHERE len(list_filter([1, 2, 3, 4], lambda i: abs(box[i] - crop[i]) <= 5 AND abs(box[i] + shift[i] - whole[i]) > 5)) = 0"""
)
def q_crop_edge(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that a crop cuts off go: those with a side near the crop's border that isn't near the image's border too."""
    near = lambda side, axis, crop, image: (F.abs(F.col(side) - crop) <= 5) & ~(F.abs(F.col(side) + F.expr(CROP_AT[axis]) - image) <= 5)
    cut = near("x1", "x", 0, 0) | near("x2", "x", 60, 180) | near("y1", "y", 0, 0) | near("y2", "y", 45, 120)
    return keyed(boxes(spark, d).where(~cut))


LVIS = "part % 10 IN (1, 3, 5) AND (x2 - x1) * (y2 - y1) > 50 AND (x2 - x1) * (y2 - y1) < 600"


@query(f"WITH {BOXES} SELECT {KEY} FROM b WHERE {LVIS}")
def q_annotation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of some categories whose area lies strictly between two bounds."""
    return keyed(boxes(spark, d).where(LVIS))


CROP_OK = "(x1 + x2) / 2 > 20 AND (x1 + x2) / 2 < 80 AND (y1 + y2) / 2 > 10 AND (y1 + y2) / 2 < 70"
CROPPED = {"cx1": "greatest(x1, 20) - 20", "cy1": "greatest(y1, 10) - 10", "cx2": "least(x2, 80) - 20", "cy2": "least(y2, 70) - 10"}


@query(f"WITH {BOXES} SELECT {KEY}, {', '.join(f'{e} AS {c}' for c, e in CROPPED.items())} FROM b WHERE {CROP_OK}")
def q_crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A crop keeps boxes whose centre is strictly inside, clipped and shifted to its corner."""
    return keyed(boxes(spark, d).where(CROP_OK), *[f"{e} AS {c}" for c, e in CROPPED.items()])


COVER = "greatest(0, least(x2, 80) - greatest(x1, 20)) * greatest(0, least(y2, 70) - greatest(y1, 10))"
RELATIVE = {"relative": f"round({COVER} / (60.0 * 60.0), 9)", "with_eps": f"round({COVER} / ((x2 - x1) * (y2 - y1) + 3600.0 - {COVER} + 1e-6), 9)"}


@query(f"WITH {BOXES} SELECT {KEY}, {', '.join(f'{e} AS {c}' for c, e in RELATIVE.items())} FROM b")
def q_relative_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The overlap with a window, over the window's area and over the union with a small constant."""
    return keyed(boxes(spark, d), *[f"{e} AS {c}" for c, e in RELATIVE.items()])


UNION = {"ux1": "greatest(0, least(x1, 30) - 4)", "uy1": "greatest(0, least(y1, 30) - 4)", "ux2": "least(100, greatest(x2, 50) + 4)", "uy2": "least(100, greatest(y2, 50) + 4)"}


@query(f"WITH {BOXES} SELECT {KEY}, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in UNION.items())} FROM b")
def q_union_box(spark: SparkSession, d: str) -> DataFrame:
    """The hull of a box and a fixed one, with a margin, inside the image."""
    return keyed(boxes(spark, d), *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in UNION.items()])


_W, _H = "(x2 - x1 + 1)", "(y2 - y1 + 1)"
CODED = {"tx": f"10 * ((x1 + 0.5 * {_W}) - 40) / 30", "ty": f"10 * ((y1 + 0.5 * {_H}) - 45) / 50", "tw": f"5 * ln({_W} / 30)", "th": f"5 * ln({_H} / 50)"}
DECODED = {"bx1": "tx / 10 * 30 + 40 - 0.5 * exp(tw / 5) * 30", "by1": "ty / 10 * 50 + 45 - 0.5 * exp(th / 5) * 50", "bx2": "tx / 10 * 30 + 40 + 0.5 * exp(tw / 5) * 30 - 1", "by2": "ty / 10 * 50 + 45 + 0.5 * exp(th / 5) * 50 - 1"}


def rounded(exprs: dict[str, str], digits: int = 6) -> list[str]:
    return [f"round({e}, {digits}) AS {c}" for c, e in exprs.items()]


@query(f"WITH {BOXES}, c AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in CODED.items())} FROM b) SELECT {KEY}, {', '.join(rounded({c: c for c in CODED} | DECODED))} FROM c")
def q_box_coding(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as weighted offsets to an anchor, and decoded again."""
    coded = boxes(spark, d).selectExpr("*", *[f"{e} AS {c}" for c, e in CODED.items()])
    return keyed(coded, *rounded({c: c for c in CODED} | DECODED))


CAMERA = {"ex": "9.6 * cos(radians(qty)) * cos(radians(part % 360))", "ey": "9.6 * cos(radians(qty)) * sin(radians(part % 360))", "ez": "9.6 * sin(radians(qty))"}


@query(f"WITH {POINTS} SELECT {KEY}, {', '.join(rounded(CAMERA))} FROM p")
def q_camera_position(spark: SparkSession, d: str) -> DataFrame:
    """Where the camera stands for an elevation and an azimuth, at a radius of half the diagonal times the zoom."""
    return keyed(points(spark, d), *rounded(CAMERA))


PROJECT = {"u": "50 * px / (pz + 6) + 32", "v": "50 * py / (pz + 6) + 24"}


@query(f"WITH {POINTS}, q AS (SELECT {KEY}, round_even({PROJECT['u']}, 0) AS u, round_even({PROJECT['v']}, 0) AS v FROM p) SELECT {KEY}, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM q WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48")
def q_projection(spark: SparkSession, d: str) -> DataFrame:
    """Pinhole projection, rounded half to even; points outside the image go."""
    at = keyed(points(spark, d), *[f"rint({e}) AS {c}" for c, e in PROJECT.items()])
    return at.where("u >= 0 and u < 64 and v >= 0 and v < 48").withColumns({c: F.col(c).cast(LONG) for c in PROJECT})


@query(
    f"""WITH {POINTS}, c AS (SELECT *, px - avg(px) OVER w AS cx, py - avg(py) OVER w AS cy, pz - avg(pz) OVER w AS cz FROM p WINDOW w AS (PARTITION BY image)),
    s AS (SELECT *, max(sqrt(cx * cx + cy * cy + cz * cz)) OVER w AS r, max(greatest(abs(cx), abs(cy), abs(cz))) OVER w AS m FROM c WINDOW w AS (PARTITION BY image))
    SELECT {KEY}, round(CASE WHEN r > 1e-9 THEN cx / r END, 6) AS ball_x, round(CASE WHEN m > 1e-9 THEN 0.75 * cy / m END, 6) AS box_y, round(cz, 6) AS centred_z FROM s"""
)
def q_normalise_points(spark: SparkSession, d: str) -> DataFrame:
    """A shape centred, scaled to the unit ball and to a box; sums and maxima are partial by task, not a window over the shape."""
    p = points(spark, d)
    c = p.join(p.groupBy("image").agg(*[F.avg(x).alias(f"m{x}") for x in POINT]), "image").selectExpr("*", "px - mpx AS cx", "py - mpy AS cy", "pz - mpz AS cz")
    s = c.join(c.groupBy("image").agg(F.max(F.expr("sqrt(cx * cx + cy * cy + cz * cz)")).alias("r"), F.max(F.expr("greatest(abs(cx), abs(cy), abs(cz))")).alias("m")), "image")
    return keyed(s, "round(CASE WHEN r > 1e-9 THEN cx / r END, 6) AS ball_x", "round(CASE WHEN m > 1e-9 THEN 0.75 * cy / m END, 6) AS box_y", "round(cz, 6) AS centred_z")


TURNED = {"rx": "cos(radians(30)) * px - sin(radians(30)) * py", "ry": "sin(radians(30)) * px + cos(radians(30)) * py", "rz": "pz", "sx": "px", "sy": "-pz", "sz": "py"}


@query(f"WITH {POINTS} SELECT {KEY}, {', '.join(rounded(TURNED))} FROM p")
def q_rotate_swap(spark: SparkSession, d: str) -> DataFrame:
    """A turn about the vertical, and the axes of another convention."""
    return keyed(points(spark, d), *rounded(TURNED))


#: v + 2 w (q x v) + 2 q x (q x v) for the unit quaternion (0.8, 0.6, 0, 0): a turn about x.
QUATERNION = {"qx": "px", "qy": "py * (1 - 2 * 0.6 * 0.6) - 2 * 0.8 * 0.6 * pz", "qz": "pz * (1 - 2 * 0.6 * 0.6) + 2 * 0.8 * 0.6 * py"}


@query(f"WITH {POINTS} SELECT {KEY}, {', '.join(rounded(QUATERNION))} FROM p WHERE part IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def q_rotate_parts(spark: SparkSession, d: str) -> DataFrame:
    """The points of some parts, turned by a quaternion."""
    moving = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("part"))
    return keyed(points(spark, d).join(moving, "part", "left_semi"), *rounded(QUATERNION))


@query(
    f"""WITH {POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY line, part, supp, qty, px) AS k FROM p)
    SELECT a.image, a.k, round(sqrt(pow(b.px - a.px, 2) + pow(b.py - a.py, 2) + pow(b.pz - a.pz, 2)), 6) AS length FROM o a JOIN o b ON a.image = b.image AND b.k = a.k + 1"""
)
def q_edge_length(spark: SparkSession, d: str) -> DataFrame:
    """The lengths of a path's edges."""
    w = Window.partitionBy("image").orderBy("line", "part", "supp", "qty", "px")
    o = points(spark, d).withColumns({"k": F.row_number().over(w).cast(LONG)} | {f"n{c}": F.lead(c).over(w) for c in POINT})
    return o.where("npx is not null").selectExpr("image", "k", "round(sqrt(pow(npx - px, 2) + pow(npy - py, 2) + pow(npz - pz, 2)), 6) AS length")


@query(
    """SELECT user_id, CAST(coalesce(min(event_id % 64) FILTER (value > 30), 0) AS BIGINT) AS x1, CAST(coalesce(min(event_id // 64 % 64) FILTER (value > 30), 0) AS BIGINT) AS y1, CAST(coalesce(max(event_id % 64) FILTER (value > 30), 0) AS BIGINT) AS x2,
    CAST(coalesce(max(event_id // 64 % 64) FILTER (value > 30), 0) AS BIGINT) AS y2, round(count(*) FILTER (value > 31) / nullif(count(*) FILTER (value > 29), 0), 6) AS stability FROM events GROUP BY user_id"""
)
def q_mask_box(spark: SparkSession, d: str) -> DataFrame:
    """The box of a mask's pixels (zeros if it has none), and how stable its area is under a shifted threshold."""
    x, y, on = F.col("event_id") % 64, F.floor(F.col("event_id") / 64) % 64, F.col("value") > 30
    ends = [F.coalesce(f(F.when(on, v)), F.lit(0)).cast(LONG).alias(name) for name, f, v in (("x1", F.min, x), ("y1", F.min, y), ("x2", F.max, x), ("y2", F.max, y))]
    return table(spark, d, "events").groupBy("user_id").agg(*ends, F.round(F.try_divide(F.count_if(F.col("value") > 31), F.count_if(F.col("value") > 29)), 6).alias("stability"))


@query(
    """WITH s AS (SELECT l_orderkey AS image, min(l_partkey % 97) AS w, min(l_suppkey % 89) AS h FROM lineitem GROUP BY 1)
    SELECT image, layer, i, j, round(w * i / pow(2, layer), 6) AS x, round(h * j / pow(2, layer), 6) AS y FROM s, (VALUES (0), (1), (2)) l(layer), range(0, 4) a(i), range(0, 4) b(j) WHERE i < pow(2, layer) AND j < pow(2, layer)"""
)
def q_crop_grid(spark: SparkSession, d: str) -> DataFrame:
    """The corners of an image's crops in layers of one, four and sixteen."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.min(F.col("l_partkey") % 97).alias("w"), F.min(F.col("l_suppkey") % 89).alias("h"))
    side = lambda: F.sequence(F.lit(0), F.pow(F.lit(2), F.col("layer")).cast("int") - 1)
    grid = s.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("i", F.explode(side())).withColumn("j", F.explode(side()))
    return grid.selectExpr("image", "layer", "CAST(i AS BIGINT) AS i", "CAST(j AS BIGINT) AS j", "round(w * i / pow(2, layer), 6) AS x", "round(h * j / pow(2, layer), 6) AS y")


@query(
    f"""WITH {BOXES}, g AS (SELECT image, line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b GROUP BY ALL)
    SELECT a.image, a.line AS a, b.line AS b FROM g a JOIN g b ON a.image = b.image AND a.line < b.line WHERE greatest(a.x1 - b.x2, b.x1 - a.x2, a.y1 - b.y2, b.y1 - a.y2) < 3"""
)
def q_adjacent_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one shape whose bounding boxes are less than a gap apart on every axis; a shape has a few parts."""
    g = boxes(spark, d).groupBy("image", "line").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    parts = g.groupBy("image").agg(F.collect_list(F.struct("line", "x1", "y1", "x2", "y2")).alias("parts"))
    pairs = parts.select("image", F.explode("parts").alias("a"), "parts").select("image", "a", F.explode("parts").alias("b")).where("a.line < b.line")
    return pairs.where("greatest(a.x1 - b.x2, b.x1 - a.x2, a.y1 - b.y2, b.y1 - a.y2) < 3").select("image", F.col("a.line").alias("a"), F.col("b.line").alias("b"))


@query(
    f"""WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY part, supp, line, qty) AS k FROM b), p AS (SELECT a.image, a.k AS a, b.k AS b, a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 AS meet FROM o a JOIN o b ON a.image = b.image AND a.k <> b.k),
    f AS (SELECT *, bool_or(meet) OVER (PARTITION BY image) AS any_meet FROM p) SELECT image, a, b FROM f WHERE meet OR NOT any_meet"""
)
def q_overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of an image's boxes that overlap; all pairs where none do. An image has a few boxes."""
    k = F.row_number().over(Window.partitionBy("image").orderBy("part", "supp", "line", "qty")).cast(LONG)
    one = boxes(spark, d).withColumn("k", k).groupBy("image").agg(F.collect_list(F.struct("k", "x1", "y1", "x2", "y2")).alias("all"))
    meet = lambda a, b: (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])
    pairs = F.filter(F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: F.struct(a["k"].alias("a"), b["k"].alias("b"), meet(a, b).alias("meet"))))), lambda p: p["a"] != p["b"])
    one = one.select("image", pairs.alias("pairs")).withColumn("any", F.exists("pairs", lambda p: p["meet"]))
    return one.select("image", "any", F.inline("pairs")).where("meet or not any").select("image", "a", "b")


@query(
    f"""WITH {POINTS}, s AS (SELECT image, line, count(*) AS n, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM p GROUP BY ALL)
    SELECT DISTINCT s.image, s.line FROM s JOIN p ON s.image = p.image AND p.qty > 45 WHERE pow(cx - px, 2) + pow(cy - py, 2) + pow(cz - pz, 2) < 9"""
)
def q_near_hits(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose centre is within a distance of one of the shape's hits."""
    p = points(spark, d)
    s = p.groupBy("image", "line").agg(*[F.avg(c).alias(f"c{c[1]}") for c in POINT])
    hits = p.where("qty > 45").groupBy("image").agg(F.collect_list(F.struct(*POINT)).alias("hits"))
    near = F.exists("hits", lambda h: F.pow(F.col("cx") - h["px"], 2) + F.pow(F.col("cy") - h["py"], 2) + F.pow(F.col("cz") - h["pz"], 2) < 9)
    return s.join(hits, "image").where(near).select("image", "line")


@query(
    """WITH e AS (SELECT l_orderkey AS mesh, least(l_partkey % 12, l_suppkey % 12) AS a, greatest(l_partkey % 12, l_suppkey % 12) AS b, l_linenumber % 2 AS side FROM lineitem WHERE l_partkey % 12 <> l_suppkey % 12),
    n AS (SELECT mesh, a, b, count(*) AS n, count(DISTINCT side) AS sides FROM e GROUP BY ALL), m AS (SELECT *, max(sides) OVER (PARTITION BY mesh) AS most FROM n)
    SELECT mesh, a, b, CASE WHEN sides = 2 THEN 'shared' ELSE 'boundary' END AS kind FROM m WHERE sides = 2 OR (most = 1 AND n = 1)"""
)
def q_shared_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that two faces share; where a shape has no such edge, those on its boundary (of one triangle)."""
    v, w = F.col("l_partkey") % 12, F.col("l_suppkey") % 12
    e = table(spark, d, "lineitem").where(v != w).select(F.col("l_orderkey").alias("mesh"), F.least(v, w).alias("a"), F.greatest(v, w).alias("b"), (F.col("l_linenumber") % 2).alias("side"))
    n = e.groupBy("mesh", "a", "b").agg(F.count("*").alias("n"), (F.min("side") != F.max("side")).alias("both"))
    n = n.join(n.groupBy("mesh").agg(F.max("both").alias("some")), "mesh").where("both or (not some and n = 1)")
    return n.select("mesh", "a", "b", F.when(F.col("both"), "shared").otherwise("boundary").alias("kind"))


@query(
    """WITH v AS (SELECT o_orderkey AS view, (o_orderkey // 6 % 5) * 15 AS el, o_orderkey % 12 * 30 AS az, o_custkey AS shape FROM orders),
    s AS (SELECT l_orderkey AS view, count(*) AS n, count(*) FILTER (l_returnflag = 'R') + 2 * count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A') AS occluded FROM lineitem GROUP BY 1)
    SELECT shape, v.view, el, az, CAST(coalesce(occluded, 2) AS BIGINT) AS occluded, row_number() OVER (PARTITION BY shape ORDER BY coalesce(occluded, 2), el DESC, az, v.view) AS place FROM v LEFT JOIN s ON s.view = v.view"""
)
def q_visibility_rank(spark: SparkSession, d: str) -> DataFrame:
    """Views of a shape from the least occluded; a ray that hits nothing counts two, ties go to the higher elevation, then the azimuth."""
    views = table(spark, d, "orders").selectExpr("o_orderkey AS view", "(o_orderkey div 6 % 5) * 15 AS el", "o_orderkey % 12 * 30 AS az", "o_custkey AS shape")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("view")).agg((F.count_if(F.col("l_returnflag") == "R") + 2 * F.count_if(F.expr("l_linestatus = 'O' and l_returnflag = 'A'"))).alias("occluded"))
    both = views.join(seen, "view", "left").withColumn("occluded", F.coalesce("occluded", F.lit(2)).cast(LONG))
    return both.select("shape", "view", "el", "az", "occluded", F.row_number().over(Window.partitionBy("shape").orderBy("occluded", F.desc("el"), "az", "view")).cast(LONG).alias("place"))


@query(
    f"""WITH {POINTS}, m AS (SELECT image, part % 4 AS mask, avg(px) AS fx, avg(py) AS fy FROM p WHERE qty > 5 GROUP BY ALL)
    SELECT image, mask, round(fx / (sqrt(fx * fx + fy * fy) + 1e-6), 6) AS fx, round(fy / (sqrt(fx * fx + fy * fy) + 1e-6), 6) AS fy FROM m"""
)
def q_mask_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean features of each mask's points, scaled to length one; a small constant guards the division."""
    m = points(spark, d).where("qty > 5").groupBy("image", (F.col("part") % 4).alias("mask")).agg(F.avg("px").alias("fx"), F.avg("py").alias("fy"))
    return m.selectExpr("image", "mask", "round(fx / (sqrt(fx * fx + fy * fy) + 1e-6), 6) AS fx", "round(fy / (sqrt(fx * fx + fy * fy) + 1e-6), 6) AS fy")


@query(
    f"""WITH {POINTS}, t AS (SELECT *, line * qty AS w FROM p), c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY image ORDER BY part, supp, line, qty, px ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(w) OVER (PARTITION BY image) AS total FROM t),
    s AS (SELECT image, i, (i + 0.5) / 4 * total AS at FROM (SELECT DISTINCT image, total FROM c), range(0, 4) z(i))
    SELECT s.image, s.i, c.part, c.line, c.qty FROM s JOIN c ON s.image = c.image AND s.at >= c.lo AND s.at < c.lo + c.w"""
)
def q_area_weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four stratified samples of a shape, each on the face in whose share of the area it falls; a face may be taken again."""
    w = Window.partitionBy("image").orderBy("part", "supp", "line", "qty", "px").rowsBetween(Window.unboundedPreceding, -1)
    t = points(spark, d).selectExpr("*", "line * qty AS w")
    c = t.withColumns({"lo": F.coalesce(F.sum("w").over(w), F.lit(0.0)), "total": F.sum("w").over(Window.partitionBy("image"))})
    i = F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: ((i + 0.5) / 4 * F.col("total") >= F.col("lo")) & ((i + 0.5) / 4 * F.col("total") < F.col("lo") + F.col("w"))))
    return c.select("image", i.alias("i"), "part", "line", "qty").withColumn("i", F.col("i").cast(LONG))


@query(
    f"""WITH {POINTS}, c AS (SELECT image, avg(px) AS cx, avg(py) AS cy FROM p GROUP BY 1), o AS (SELECT p.*, row_number() OVER (PARTITION BY p.image ORDER BY round(pow(px - cx, 2) + pow(py - cy, 2), 9), part, supp, line, qty) AS place, count(*) OVER (PARTITION BY p.image) AS n FROM p JOIN c ON p.image = c.image)
    SELECT {KEY} FROM o WHERE place <= greatest(1, n * 0.8)"""
)
def q_crop_points(spark: SparkSession, d: str) -> DataFrame:
    """The four fifths of a shape's points that are nearest to its centre."""
    p = points(spark, d)
    c = p.join(p.groupBy("image").agg(F.avg("px").alias("cx"), F.avg("py").alias("cy")), "image").withColumn("far", F.expr("round(pow(px - cx, 2) + pow(py - cy, 2), 9)"))
    w = Window.partitionBy("image")
    o = c.withColumns({"place": F.row_number().over(w.orderBy("far", "part", "supp", "line", "qty")), "n": F.count("*").over(w)})
    return keyed(o.where(F.col("place") <= F.greatest(F.lit(1.0), F.col("n") * 0.8)))


@query(
    f"""WITH {POINTS}, g AS (SELECT image, part % 3 AS obj, avg(px) AS x, avg(py) AS y, avg(pz) AS z, count(*) AS n FROM p GROUP BY ALL), big AS (SELECT * FROM g WHERE n >= 2), s AS (SELECT * FROM g WHERE n < 2)
    SELECT s.image, s.obj, arg_min(big.obj, round(pow(s.x - big.x, 2) + pow(s.y - big.y, 2) + pow(s.z - big.z, 2), 9) + big.obj * 1e-12) AS into_obj FROM s JOIN big ON s.image = big.image GROUP BY ALL"""
)
def q_merge_small(spark: SparkSession, d: str) -> DataFrame:
    """Each small component of a shape with the large one that is nearest; components of a shape are few."""
    g = points(spark, d).groupBy("image", (F.col("part") % 3).alias("obj")).agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.avg("pz").alias("z"), F.count("*").alias("n"))
    big = g.where("n >= 2").groupBy("image").agg(F.collect_list(F.struct("obj", "x", "y", "z")).alias("big"))
    dist = lambda b: F.round(F.pow(F.col("x") - b["x"], 2) + F.pow(F.col("y") - b["y"], 2) + F.pow(F.col("z") - b["z"], 2), 9)
    near = F.array_min(F.transform("big", lambda b: F.struct(dist(b).alias("d"), b["obj"].alias("obj"))))
    return g.where("n < 2").join(big, "image").select("image", "obj", near["obj"].alias("into_obj"))


@query(
    f"""WITH {POINTS}, m AS (SELECT DISTINCT image, supp % 5 AS mask, part % 40 AS pixel FROM p), x AS (SELECT image, part % 40 AS pixel, px, py, pz FROM p WHERE qty > 5),
    f AS (SELECT m.image, mask, count(*) AS n, avg(px) AS fx, avg(py) AS fy, avg(pz) AS fz FROM m JOIN x USING (image, pixel) GROUP BY ALL)
    SELECT image, mask, n, round(fx / (sqrt(fx * fx + fy * fy + fz * fz) + 1e-6), 6) AS fx, round(fy / (sqrt(fx * fx + fy * fy + fz * fz) + 1e-6), 6) AS fy, round(fz / (sqrt(fx * fx + fy * fy + fz * fz) + 1e-6), 6) AS fz FROM f"""
)
def q_mask_join_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean features of the points whose pixel a mask holds, scaled to length one; masks may overlap, so a point counts for several."""
    p = points(spark, d)
    masks = p.selectExpr("image", "supp % 5 AS mask", "part % 40 AS pixel").distinct()
    seen = p.where("qty > 5").selectExpr("image", "part % 40 AS pixel", "px", "py", "pz")
    f = masks.join(seen, ["image", "pixel"]).groupBy("image", "mask").agg(F.count("*").alias("n"), *[F.avg(f"p{a}").alias(f"f{a}") for a in "xyz"])
    size = F.sqrt(sum((F.col(f"f{a}") * F.col(f"f{a}") for a in "xyz"), F.lit(0.0))) + 1e-6
    return f.select("image", "mask", "n", *[F.round(F.col(f"f{a}") / size, 6).alias(f"f{a}") for a in "xyz"])


@query(
    f"""WITH {POINTS}, g AS (SELECT image, line, min(px) AS x1, min(py) AS y1, min(pz) AS z1, max(px) + 1 AS x2, max(py) + 1 AS y2, max(pz) + 1 AS z2 FROM p GROUP BY ALL),
    j AS (SELECT a.image, a.line AS a, b.line AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) * greatest(0, least(a.z2, b.z2) - greatest(a.z1, b.z1)) AS meet,
      (a.x2 - a.x1) * (a.y2 - a.y1) * (a.z2 - a.z1) AS va, (b.x2 - b.x1) * (b.y2 - b.y1) * (b.z2 - b.z1) AS vb, (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) * (greatest(a.z2, b.z2) - least(a.z1, b.z1)) AS hull FROM g a JOIN g b ON a.image = b.image AND b.line = a.line + 1)
    SELECT image, a, b, round(meet / (va + vb - meet), 6) AS iou, round(meet / (va + vb - meet) - (hull - (va + vb - meet)) / hull, 6) AS giou FROM j"""
)
def q_box_iou_3d(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the boxes in space of each two lines that follow each other, and its form that also counts the gap between them."""
    ends = [f(f"p{a}").alias(f"{a}1") if f is F.min else (f(f"p{a}") + 1).alias(f"{a}2") for a in "xyz" for f in (F.min, F.max)]
    g = points(spark, d).groupBy("image", "line").agg(*ends)
    sides = [f"{a}{k}" for a in "xyz" for k in (1, 2)]
    other = g.select("image", (F.col("line") - 1).alias("line"), *[F.col(c).alias(f"o{c}") for c in sides])
    j = g.join(other, ["image", "line"])
    product = lambda of: of("x") * of("y") * of("z")
    col = F.col
    meet = product(lambda a: F.greatest(F.lit(0.0), F.least(col(f"{a}2"), col(f"o{a}2")) - F.greatest(col(f"{a}1"), col(f"o{a}1"))))
    hull = product(lambda a: F.greatest(col(f"{a}2"), col(f"o{a}2")) - F.least(col(f"{a}1"), col(f"o{a}1")))
    union = product(lambda a: col(f"{a}2") - col(f"{a}1")) + product(lambda a: col(f"o{a}2") - col(f"o{a}1")) - meet
    return j.select("image", col("line").alias("a"), (col("line") + 1).alias("b"), F.round(meet / union, 6).alias("iou"), F.round(meet / union - (hull - union) / hull, 6).alias("giou"))


@query(
    f"""WITH {BOXES}, w AS (SELECT image, i, CAST('0x' || substr(md5(concat_ws('/', CAST(image AS VARCHAR), CAST(i AS VARCHAR))), 1, 4) AS BIGINT) % 60 AS wx, CAST('0x' || substr(md5(concat_ws('/', CAST(image AS VARCHAR), CAST(i AS VARCHAR))), 5, 4) AS BIGINT) % 50 AS wy FROM (SELECT DISTINCT image FROM b), range(0, 8) t(i)),
    o AS (SELECT w.*, b.part, b.supp, b.line, b.qty, x1, y1, x2, y2, greatest(0, least(x2, wx + 60) - greatest(x1, wx)) * greatest(0, least(y2, wy + 55) - greatest(y1, wy)) AS meet, (x1 + x2) / 2 > wx AND (x1 + x2) / 2 < wx + 60 AND (y1 + y2) / 2 > wy AND (y1 + y2) / 2 < wy + 55 AS inside FROM w JOIN b USING (image)),
    a AS (SELECT image, min(i) AS i FROM (SELECT image, i FROM o GROUP BY ALL HAVING bool_or(inside) AND min(CASE WHEN inside THEN round(meet / ((x2 - x1) * (y2 - y1)), 9) END) >= 0.5) GROUP BY image)
    SELECT image, i, part, supp, line, qty, greatest(x1, wx) - wx AS cx1, greatest(y1, wy) - wy AS cy1, least(x2, wx + 60) - wx AS cx2, least(y2, wy + 55) - wy AS cy2 FROM o JOIN a USING (image, i) WHERE inside"""
)
def q_accepted_crop(spark: SparkSession, d: str) -> DataFrame:
    """The first of eight hashed windows that cuts no box too far: of each box whose centre it holds at least half is left. Its boxes, clipped
    and shifted; images without such a window give none.
    """
    b = dealt(boxes(spark, d), "image")
    # the windows are hashed once for each image, not for each box; both sides are dealt alike, so the join shuffles nothing
    names = b.select("image").distinct().withColumns({f"name{i}": F.md5(F.concat_ws("/", F.col("image").cast("string"), F.lit(str(i)))) for i in range(8)})
    at = lambda name, k, n: F.conv(F.substring(name, k, 4), 16, 10).cast(LONG) % n
    b = b.join(names.select("image", *[at(f"name{i}", 1, 60).alias(f"wx{i}") for i in range(8)], *[at(f"name{i}", 5, 50).alias(f"wy{i}") for i in range(8)]), "image")

    def left(i: int) -> Column:
        """What the window leaves of a box whose centre it holds."""
        inside = F.expr(f"(x1 + x2) / 2 > wx{i} AND (x1 + x2) / 2 < wx{i} + 60 AND (y1 + y2) / 2 > wy{i} AND (y1 + y2) / 2 < wy{i} + 55")
        w, h = (F.least(F.col(f"{c}2"), F.col(f"w{c}{i}") + n) - F.greatest(F.col(f"{c}1"), F.col(f"w{c}{i}")) for c, n in (("x", 60), ("y", 55)))
        return F.when(inside, F.round(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 9))

    image = Window.partitionBy("image")
    o = b.withColumns({f"left{i}": left(i) for i in range(8)})
    o = o.withColumns({f"least{i}": F.min(f"left{i}").over(image) for i in range(8)})
    o = o.withColumn("i", F.coalesce(*[F.when(F.col(f"least{i}") >= 0.5, F.lit(i).cast(LONG)) for i in range(8)])).where("i is not null")
    own = lambda c: F.get(F.array(*[F.col(f"{c}{i}") for i in range(8)]), F.col("i").cast("int"))
    o = o.where(own("left").isNotNull()).select("image", "i", "part", "supp", "line", "qty", "x1", "y1", "x2", "y2", own("wx").alias("wx"), own("wy").alias("wy"))
    low = lambda c: (F.greatest(f"{c}1", f"w{c}") - F.col(f"w{c}")).alias(f"c{c}1")
    high = lambda c, n: (F.least(F.col(f"{c}2"), F.col(f"w{c}") + n) - F.col(f"w{c}")).alias(f"c{c}2")
    return o.select("image", "i", "part", "supp", "line", "qty", low("x"), low("y"), high("x", 60), high("y", 55))

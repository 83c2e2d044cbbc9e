"""Masks and spatial joins against brute force written apart from them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktally.operators import raster, space


def parts_by_force(pixels):
    left, out = set(pixels), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for p in itertools.product((x - 1, x, x + 1), (y - 1, y, y + 1)):
                if p in left:
                    left.remove(p)
                    part.add(p)
                    todo.append(p)
        out.append(part)
    return sorted(out, key=lambda p: min((y, x) for x, y in p))


def first(part):
    return min((y, x) for x, y in part)


@pytest.fixture(scope="module")
def masks():
    """Noise of several densities, one long snake over many tiles, a full square, single pixels; coordinates below zero."""
    rng = random.Random(4)
    made = {f"noise{d}": {(x, y) for x in range(-9, 30) for y in range(-5, 26) if rng.random() < d / 10} for d in (1, 3, 4, 6, 9)}
    made["snake"] = {(x, y) for y in range(0, 41, 2) for x in range(50)} | {(49 if y % 4 == 1 else 0, y) for y in range(1, 41, 2)}
    made["full"] = {(x, y) for x in range(16) for y in range(16)}
    made["dots"] = {(x, y) for x in range(0, 30, 3) for y in range(0, 30, 3)}
    return made


def pixel_rows(spark, masks):
    rows = [(m, x, y, "?") for m, p in masks.items() for x, y in p]
    rows += [rows[0]] * 50 + [(None, 1, 1, "?"), ("full", None, 1, "?"), ("full", 3, None, "?")]
    return spark.createDataFrame(rows, "mask string, x long, y int, area string").repartition(3)


@pytest.mark.parametrize("tile", [4, 7, 128])
def test_components_and_what_is_kept(spark, masks, tile):
    parts = {m: parts_by_force(p) for m, p in masks.items()}
    runs = raster.components(pixel_rows(spark, masks), tile).cache()
    got = {(r.mask, r.cy, r.cx, r.area) for r in runs.collect()}
    assert got == {(m, *first(p), len(p)) for m, ps in parts.items() for p in ps}
    of = lambda df: {(r.mask, r.x, r.y) for r in raster.pixels_of(df).collect()}
    want = lambda keep: {(m, x, y) for m, ps in parts.items() for p in keep(ps) for x, y in p}
    assert of(runs) == want(lambda ps: ps)
    assert of(raster.keep_largest(runs)) == want(lambda ps: [max(ps, key=len)])
    assert of(raster.drop_smallest(runs)) == want(lambda ps: ps if len(ps) == 1 else [p for p in ps if p is not min(ps, key=len)])
    assert of(raster.drop_islands(runs, 9)) == want(lambda ps: [p for p in ps if len(p) >= 9] or [max(ps, key=len)])


@pytest.mark.parametrize("tile", [5, 128])
def test_holes(spark, masks, tile):
    width, height = 28, 23
    sizes = spark.createDataFrame([(m, width, height) for m in [*masks, "empty"]] + [("nothing", 0, 5)], "mask string, width int, height int")
    want = set()
    for m, p in [*masks.items(), ("empty", set())]:
        holes = {(x, y) for x in range(width) for y in range(height)} - p
        want |= {(m, x, y) for part in parts_by_force(holes) if len(part) < 6 for x, y in part}
    got = raster.pixels_of(raster.fill_holes(pixel_rows(spark, masks), sizes, 6, tile))
    assert {(r.mask, r.x, r.y) for r in got.collect()} == want


def test_no_pixels(spark):
    none = spark.createDataFrame([], "mask string, x long, y long")
    assert raster.components(none).count() == 0 and raster.keep_largest(raster.components(none)).count() == 0


def corners(df_rows):
    return [(m, i, *map(float, v)) for m, i, v in df_rows]


TRI = "mesh string, tri long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz")


def hit_by_force(o, d, tris):
    best = None
    for i, v in tris:
        a, b, c = (np.array(v[k : k + 3]) for k in (0, 3, 6))
        m = np.stack([b - a, c - a, -d], axis=1)
        if abs(np.linalg.det(m)) > 1e-12:
            u, w, t = np.linalg.solve(m, o - a)
            if u >= -1e-12 and w >= -1e-12 and u + w <= 1 + 1e-12 and t >= 0:
                best = min(best or (np.inf, 0), (round(t, 7), i))
    return best


@pytest.mark.parametrize("size", [0.7, 3.0, 100.0])
def test_nearest_hits(spark, size):
    rng = np.random.default_rng(2)
    data = {m: [(i, (np.repeat(rng.integers(-8, 9, 3), 3).reshape(3, 3).T.ravel() + rng.integers(0, 4, 9)).astype(float).tolist()) for i in range(60)] for m in "ab"}
    data["a"] += [(100, [0, 0, 5, 4, 0, 5, 0, 4, 5]), (101, [4, 0, 5, 4, 4, 5, 0, 4, 5])]  # two that share an edge
    rays = [("a", 1000, [0, 0, -20], [0, 0, 1]), ("a", 1001, [2, 2, -20], [0, 0, 2]), ("a", 1002, [-20, 3, 3], [1, 0, 0]), ("a", 1003, [0, 0, 0], [0, 0, 0]), ("c", 1004, [0, 0, 0], [1, 0, 0])]
    rays += [(m, k, rng.integers(-12, 13, 3).tolist(), rng.choice([-1, -0.5, 0, 0.5, 1], 3).tolist()) for k in range(150) for m in ["ab"[k % 2]]]
    t = spark.createDataFrame(corners([(m, i, v) for m, ts in data.items() for i, v in ts]) + [("a", 7, None, *[1.0] * 8), ("a", 8, float("nan"), *[1.0] * 8)], TRI)
    r = spark.createDataFrame([(m, k, *map(float, [*o, *d])) for m, k, o, d in rays], "mesh string, ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = space.nearest_hits(r, t, ["mesh"], size)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(x.mesh, x.ray): (round(x.t, 7), x.tri) for x in found.collect()}
    want = {(m, k): hit_by_force(np.array(o, float), np.array(d, float), data.get(m, [])) for m, k, o, d in rays}
    assert got == {k: v for k, v in want.items() if v}
    assert space.nearest_hits(r, t.limit(0), ["mesh"], size).count() == 0


def face_distance(p, tri):
    """By a fine grid over the triangle, then by shrinking steps around the best point."""
    a, b, c = (np.array(tri[k : k + 3]) for k in (0, 3, 6))
    at, step = np.array([1 / 3, 1 / 3]), 0.5
    best = np.inf
    for _ in range(60):
        options = [at + step * np.array(s) for s in itertools.product((-1, -0.5, 0, 0.5, 1), repeat=2)]
        options = [np.clip(o, 0, 1) if np.clip(o, 0, 1).sum() <= 1 else np.clip((np.clip(o, 0, 1) + (1 - np.clip(o, 0, 1).sum()) / 2), 0, 1) for o in options]
        best, k = min((np.sum((a + o[0] * (b - a) + o[1] * (c - a) - p) ** 2), i) for i, o in enumerate(options))
        at, step = options[k], step * 0.75
    return best


def test_distance_from_a_triangle(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, [*rng.integers(-6, 7, 3), *rng.integers(-4, 5, 9)])) for _ in range(80)]
    rows += [(3.0, 4.0, 0.0, *[0.0] * 9), (1.0, 1.0, 2.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0), (5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 4.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{a} double" for p in "pabk" for a in "xyz"))
    got = [r.d2 for r in space.with_distance(df).collect()]
    assert got[-3:] == [25.0, 4.0, 1.0]
    assert all(abs(g - face_distance(np.array(r[:3]), r[3:])) < 1e-2 for g, r in zip(got, rows))


@pytest.mark.parametrize("size", [1.0, 5.0, 50.0])
def test_faces(spark, size):
    # two facets make the square 0..10 at z = 0; a wall at x = 0
    square = [("m", 1, [0, 0, 0, 10, 0, 0, 10, 10, 0]), ("m", 1, [0, 0, 0, 10, 10, 0, 0, 10, 0]), ("m", 2, [0, 0, 0, 0, 10, 0, 0, 0, 10])]
    tris = [(1, [1, 1, 0, 9, 1, 0, 1, 9, 0]), (2, [1, 1, 0.4, 9, 1, 0.4, 5, 5, 0.5]), (3, [1, 1, 0, 9, 1, 0, 1, 9, 0.6]), (4, [-0.5, 5, 5, 0.5, 1, 1, 0, 2, 2]), (5, [10.3, 10.4, 0, 10, 10, 0, 5, 5, 0]), (6, [10.4, 10.4, 0, 10, 10, 0, 5, 5, 0]), (7, [0, 0, 0, 0, 1, 0, 0, 2, 0])]
    f = spark.createDataFrame(corners(square), TRI.replace("tri long", "face long"))
    t = spark.createDataFrame(corners([("m", i, v) for i, v in tris]) + [("m", 9, None, *[0.0] * 8)], TRI)
    assert {tuple(r) for r in space.on_faces(t, f, ["mesh"], 0.5, size).collect()} == {("m", 1, 1), ("m", 1, 2), ("m", 2, 4), ("m", 1, 5), ("m", 1, 7), ("m", 2, 7)}


@pytest.mark.parametrize("size", [0.5, 4.0, 1000.0])
def test_nearest_point(spark, size):
    rng = np.random.default_rng(7)
    base = [("s", i, *rng.integers(0, 12, 3).astype(float).tolist()) for i in range(200)] + [("s", 900, 500.0, 500.0, -500.0), ("t", 901, -1e4, 0.0, 0.0), ("s", 902, None, 0.0, 0.0), ("s", 903, float("inf"), 0.0, 0.0)]
    base += [("s", 1000 + i, 300.0 + i / 100, 0.0, 0.0) for i in range(150)]  # a dense cluster far away
    asked = [("s", i, *rng.integers(-40, 60, 3).astype(float).tolist()) for i in range(60)] + [("s", 100, 1e5, 1e5, 1e5), ("s", 101, 240.0, 3.0, 3.0), ("t", 102, 7.0, 7.0, 7.0), ("none", 103, 0.0, 0.0, 0.0), ("s", 104, *base[3][2:]), ("s", 105, None, 1.0, 1.0)]
    got = {(r.scene, r.qid): (r.d2, r.id) for r in space.nearest_point(spark.createDataFrame(asked, "scene string, qid long, x double, y double, z double"), spark.createDataFrame(base, "scene string, id long, x double, y double, z double"), ["scene"], size).collect()}
    want = {}
    for s, q, *p in asked:
        near = [(round(sum((a - b) ** 2 for a, b in zip(p, v)), 9), i) for t, i, *v in base if t == s and None not in v and np.inf not in v] if None not in p else []
        if near:
            want[(s, q)] = min(near)
    assert got == want


@pytest.mark.parametrize("size,piece", [(1.0, 4), (10.0, 4), (500.0, 4096)])
def test_points_in_boxes(spark, size, piece):
    rng = random.Random(6)
    points = [("v", rng.choice("abc"), float(rng.randint(-20, 40)), float(rng.randint(-20, 40))) for _ in range(400)] + [("v", "hot", 5.0, 5.0)] * 300 + [("v", "a", None, 1.0), ("w", "a", 0.0, 0.0)]
    boxes = [("v", i, float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(0, 40))) for i in range(40) for x, y in [(rng.randint(-25, 35), rng.randint(-25, 35))]] + [("v", 99, 5.0, 0.0, 9.0, 9.0), ("v", 98, None, 0.0, 1.0, 1.0), ("u", 97, 0.0, 0.0, 9.0, 9.0), ("v", 96, 4.0, 4.0, 6.0, 6.0)]
    want = {}
    for v, b, x1, y1, x2, y2 in boxes:
        for w, part, x, y in points:
            if v == w and x is not None and x1 is not None and x1 < x < x2 and y1 < y < y2:
                want[(v, b, part)] = want.get((v, b, part), 0) + 1
    got = space.inside_counts(spark.createDataFrame(points, "view string, part string, x double, y double"), spark.createDataFrame(boxes, "view string, box long, x1 double, y1 double, x2 double, y2 double"), ["view"], size, piece)
    assert {(r.view, r.box, r.part): r.n for r in got.collect()} == want and want[("v", 96, "hot")] >= 300


def about(axis, angle):
    """Rodrigues' formula with the matrix of the cross product by the axis."""
    x, y, z = np.eye(3)[axis]
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_turns(spark):
    quarter = np.pi / 2
    rows = [[0, 1, 0, quarter, 0, 0], [0, 0, 1, 0, quarter, 0], [1, 0, 0, 0, 0, quarter], *np.random.default_rng(9).normal(size=(50, 6)).tolist()]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double, r double, w double, t double")
    got = df.select(*space.turned(space.vector(""), F.col("r"), F.col("w"), F.col("t"))).toPandas().to_numpy()
    assert np.allclose(got[:3], [[0, 0, 1], [1, 0, 0], [0, 1, 0]])
    assert np.allclose(got, [about(2, t) @ about(1, w) @ about(0, r) @ p for *p, r, w, t in rows])

"""Scenes of few rows meet whole, larger ones by cells: both give the same rows, and few bytes move."""

from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparktally.operators import raster, space, suppression


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def points(spark):
    """A small scene, one of 300 points, and copies of a point, so that there are ties."""
    rng = np.random.default_rng(11)
    made = [("small", i, *rng.integers(0, 6, 3).astype(float).tolist()) for i in range(20)] + [("large", 100 + i, *rng.integers(0, 30, 3).astype(float).tolist()) for i in range(300)]
    return spark.createDataFrame(made + [("small", 50, 1.0, 1.0, 1.0), ("small", 51, 1.0, 1.0, 1.0)], "scene string, id long, x double, y double, z double")


@pytest.mark.parametrize("few", [0, 100])
def test_nearest_point_by_levels_and_whole(spark, points, few):
    asked = points.selectExpr("scene", "id AS qid", "x + 0.3 AS x", "y - 0.3 AS y", "z AS z")
    asked = asked.unionByName(asked.where("qid < 5").selectExpr("scene", "qid + 1000 AS qid", "x", "y", "double('nan') AS z"))
    want = rows(space.nearest_point(asked, points, ["scene"], 4.0), "scene", "qid", "id", "d2")
    assert len(want) == 322
    assert rows(space.nearest_point(asked, points, ["scene"], 4.0, few=few), "scene", "qid", "id", "d2") == want


def test_equal_to_nine_places():
    values = np.array([[2.0, 1.0000000004, 1.0], [1.0000000006, 1.0, 1.0], [1.0000000005, 1.00000000149, 5.0], [np.inf, 3.0, np.inf]])
    assert space.first_least(values).tolist() == [1, 1, 0, 1]


@pytest.mark.parametrize("few", [0, 100])
@pytest.mark.parametrize("misses", [False, True])
def test_rays_by_cells_and_whole(spark, points, few, misses):
    t = points.selectExpr("scene", "id AS tri", *[f"{a} AS a{a}" for a in "xyz"], "x + 3 AS bx", "y + 1 AS by", "z AS bz", "x AS cx", "y + 3 AS cy", "z + id % 2 AS cz")
    rays = points.selectExpr("scene", "struct(id, 'r' AS name) AS ray", "x + 0.5 AS ox", "y + 0.5 AS oy", "-9.0 AS oz", "0.0 AS dx", "0.0 AS dy", "double(id % 3) AS dz")
    rays = rays.unionByName(rays.where("ray.id = 3").selectExpr("scene", "struct(2000L AS id, 'null' AS name) AS ray", "CAST(NULL AS DOUBLE) AS ox", "oy", "oz", "dx", "dy", "dz"))
    columns = ("scene", "ray.id", F.coalesce("tri", F.lit(-1)), F.coalesce("t", F.lit(-1.0)))
    want = rows(space.nearest_hits(rays, t, ["scene"], 4.0, misses=misses), *columns)
    assert sum(r[2] >= 0 for r in want) > 150 and len(want) == (323 if misses else sum(r[2] >= 0 for r in want))
    assert rows(space.nearest_hits(rays, t, ["scene"], 4.0, few, misses), *columns) == want


@pytest.mark.parametrize("few", [0, 100])
def test_boxes_by_bins_and_whole(spark, points, few):
    p = points.selectExpr("scene", "id % 3 AS part", "x", "y").unionByName(points.selectExpr("scene", "0L AS part", "x", "y"))
    boxes = points.selectExpr("scene", "id AS box", "x - 2 AS x1", "y - 1 AS y1", "x + id % 9 AS x2", "y + 4 AS y2")
    want = rows(space.inside_counts(p, boxes, ["scene"], 4.0), "scene", "box", "part", "n")
    assert want and rows(space.inside_counts(p, boxes, ["scene"], 4.0, few=few), "scene", "box", "part", "n") == want


def exchanges(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_boxes_meet_points_in_one_shuffle(points):
    boxes = points.selectExpr("scene", "id AS box", "x - 2 AS x1", "y - 1 AS y1", "x + 4 AS x2", "y + 4 AS y2")
    assert exchanges(space.inside_counts(points.selectExpr("scene", "id AS part", "x", "y"), boxes, ["scene"], 4.0)) <= 2


def test_nearest_points_are_not_sorted_pair_by_pair(points):
    found = space.nearest_point(points.withColumnRenamed("id", "qid"), points, ["scene"], 4.0)
    assert exchanges(found) <= 4 and "SortAggregate" not in str(found._jdf.queryExecution().executedPlan())


def test_pairs_of_masks_and_points_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(u, e) for u in range(3) for e in range(0, 2500, 250)] + [(None, 250), (7, None)], "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(p,) for p in [*range(1300), 250, None]], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["q_mask_points"](spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    want = {(m, p) for m in (0, 1, 2) for p in range(1300) if p % 600 in (0, 250)} | {(None, p) for p in range(1300) if p % 600 == 250}
    assert len(got) == len(set(got)) and set(got) == want
    assert "hashpartitioning(mask#" not in str(found._jdf.queryExecution().optimizedPlan()) and "Aggregate" not in str(found._jdf.queryExecution().optimizedPlan()).split("Join")[0]


def test_pairs_of_masks_and_points_come_face_by_face(spark, tmp_path):
    """Then each mask of a face is followed by the same points, and files of the pairs pack well."""
    spark.createDataFrame([(u, 500 * e + (7 * u + e) % 40) for u in range(60) for e in range(30)], "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(p,) for p in range(6000)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in entry.queries()["q_mask_points"](spark, str(tmp_path)).collect()]
    want = {(u, p) for u in range(60) for e in range(30) for p in range((7 * u + e) % 40, 6000, 600)}
    assert len(got) == len(want) and set(got) == want
    faces = [k for k, _ in groupby(p % 600 for _, p in got)]
    assert len(faces) == 40
    for f in faces:
        seen = {}
        for m, p in got:
            if p % 600 == f:
                seen.setdefault(m, []).append(p)
        assert len({tuple(x) for x in seen.values()}) == 1


@pytest.mark.parametrize("strict", [False, True])
def test_groups_of_boxes_in_rounds_and_whole(spark, strict):
    rng = np.random.default_rng(5)
    made = [(f"g{i % 4}" if i < 80 else "g0", i, float(rng.integers(1, 9)), *map(float, (x, y, x + rng.integers(0, 9), y + rng.integers(0, 9)))) for i in range(200) for x, y in [rng.integers(0, 15, 2)]]
    boxes = spark.createDataFrame(made + [("g1", 900, 1.0, None, 0.0, 1.0, 1.0), ("lone", 901, 2.0, 0.0, 0.0, 3.0, 3.0)], "g string, id long, score double, x1 double, y1 double, x2 double, y2 double")
    boxes = boxes.withColumn("rank", F.struct((-F.col("score")).alias("s"), "id"))
    want = rows(suppression.suppress(boxes, ["g"], 0.4, 1.0, strict), "g", "rank.id")
    assert 20 < len(want) < 201 and rows(suppression.suppress(boxes, ["g"], 0.4, 1.0, strict, few=40), "g", "rank.id") == want
    if not strict:
        voted = lambda few: rows(suppression.vote(boxes, ["g"], 0.4, soft=2.0, few=few), "g", "seed.id", F.coalesce("rank.id", F.lit(-1)), "n", F.round("x1", 6), F.round("y2", 6), F.round("score", 6))
        assert len(voted(512)) > 40 and voted(40) == voted(512)


@pytest.mark.parametrize("least,strict", [(0.4, False), (0.4, True), (1 / 3, False), (1 / 3, True), (1.0, False), (1.0, True)])
def test_least_overlap_is_that_of_rounding(least, strict):
    at = suppression.least_overlap(least, strict)
    ok = lambda x: (space._nine(x) > space.Decimal(repr(least))) if strict else (space._nine(x) >= space.Decimal(repr(least)))
    assert ok(at) and not ok(np.nextafter(at, 0))


def test_a_batch_of_masks_is_labelled_in_pieces(spark):
    tiles = spark.createDataFrame([(m, 0, 0, list(range(0, 16, 2))) for m in range(40)], "mask long, tx long, ty long, own array<int>").coalesce(1)
    run = raster._labelled(tiles, 4, False, most=100)
    assert run.count() == 320 and rows(run, "mask", "y", "x0", "x1", "ly", "lx") == rows(raster._labelled(tiles, 4, False), "mask", "y", "x0", "x1", "ly", "lx")


@pytest.mark.parametrize("few", [0, 100])
def test_faces_by_cells_and_whole(spark, points, few):
    """Names of any plain type, repeated and null ones too; a scene beyond the bound goes by cells."""
    t = points.selectExpr("scene", "IF(id = 7, NULL, CONCAT('t', id)) AS tri", *[f"{a} AS a{a}" for a in "xyz"], "x + 1 AS bx", "y + 1 AS by", "z AS bz", "x AS cx", "y + 1 AS cy", "IF(id = 5, double('nan'), z + id % 2) AS cz")
    t = t.unionByName(t.where("tri = 't3'").withColumns({"cx": F.col("cx") + 2}))
    f = points.where("id % 3 = 0").selectExpr("scene", "IF(id % 5 = 4, NULL, id % 5) AS face", *[f"{a} AS a{a}" for a in "xyz"], "x + 4 AS bx", "y AS by", "z + id % 4 AS bz", "x AS cx", "y + id % 4 AS cy", "z AS cz")
    columns = ("scene", F.coalesce("face", F.lit(-1)), F.coalesce("tri", F.lit("-")))
    want = rows(space.on_faces(t, f, ["scene"], 1.5, 2.0), *columns)
    assert len(want) > 100 and len({w[1] for w in want}) == 5
    assert rows(space.on_faces(t, f, ["scene"], 1.5, 2.0, few), *columns) == want


@pytest.mark.parametrize("few", [0, 512])
def test_a_corner_within_rounding_of_the_tolerance(spark, few):
    at = lambda z: [0.0, 0.0, z, 1e-4, 0.0, z, 0.0, 1e-4, z]
    columns = ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz")
    t = spark.createDataFrame([("m", 1, *at(1.02e-4)), ("m", 2, *at(1.03e-4))], f"mesh string, tri long, {columns}")
    f = spark.createDataFrame([("m", 1, *at(0.0))], f"mesh string, face long, {columns}")
    assert rows(space.on_faces(t, f, ["mesh"], 1e-4, 1.01e-4, few), "mesh", "face", "tri") == [("m", 1, 1)]


@pytest.mark.parametrize("most", [9.0, 0.25, 1e-8, 0.1 * 0.1, 1 / 3, 1e4])
def test_most_is_that_of_rounding(most):
    at = space.most_rounded(most)
    ok = lambda x: space._nine(x) <= space.Decimal(repr(most))
    assert ok(at) and not ok(np.nextafter(at, np.inf))


def test_distances_in_arrays_are_those_of_columns(spark):
    rng = np.random.default_rng(8)
    made = [tuple(map(float, [*rng.integers(-6, 7, 3), *rng.integers(-2, 3, 9)])) for _ in range(400)] + [(3.0, 4.0, 0.0, *[0.0] * 9)]
    df = spark.createDataFrame(made, ", ".join(f"{p}{a} double" for p in "pabk" for a in "xyz"))
    assert [r.d2 for r in space.with_distance(df).collect()] == space.square_distance(*np.array(made).T.reshape(4, 3, -1)).tolist()

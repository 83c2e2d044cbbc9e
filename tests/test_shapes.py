"""Boxes, points and cameras row by row against numpy, worked out from the definitions and apart from the queries' formulas."""

import os

import numpy as np
import pandas as pd
import pytest

from sparktally.plans import shapes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
KEY = ["image", "part", "supp", "line", "qty"]


@pytest.fixture(scope="module")
def lines():
    raw = pd.read_parquet(f"{DATA}/lineitem.parquet")
    df = pd.DataFrame({"image": raw.l_orderkey, "part": raw.l_partkey, "supp": raw.l_suppkey, "line": raw.l_linenumber, "qty": raw.l_quantity})
    x, y = df.part % 97, df.supp % 89
    box = np.stack([x, y, x + 5 * df.line, y + df.qty], axis=1).astype(float)
    point = np.stack([(df.part % 101) / 10 - 5, (df.supp % 83) / 10 - 4, df.qty / 10], axis=1).astype(float)
    return df, box, point


def check(spark, query, df, values, digits=5):
    """The query's rows are those of ``df`` with the columns of ``values``, in any order."""
    got = query(spark, DATA).toPandas()
    want = pd.concat([df.reset_index(drop=True), pd.DataFrame({k: np.asarray(v) for k, v in values.items()})], axis=1)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = [*KEY, *[c for c in want.columns if c not in KEY]]
    a, b = (x[order].astype(float).round(digits).sort_values(order).to_numpy() for x in (got, want))
    assert np.allclose(a, b, atol=2 * 10.0**-digits)


def test_box_modes(spark, lines):
    df, b, _ = lines
    size = b[:, 2:] - b[:, :2]
    check(spark, shapes.q_box_modes, df, {"w": size[:, 0], "h": size[:, 1], "w_pixel": size[:, 0] + 1, "h_pixel": size[:, 1] + 1, "cx": b[:, [0, 2]].mean(axis=1), "cy": b[:, [1, 3]].mean(axis=1)})


def test_filters_by_area(spark, lines):
    df, b, _ = lines
    w, h = (b[:, 2:] - b[:, :2]).T
    check(spark, shapes.q_area_bounds, df[(w * h >= 20) & (w * h <= 800) & (w >= 8) & (h >= 4)], {})
    check(spark, shapes.q_annotation_filter, df[np.isin(df.part % 10, [1, 3, 5]) & (w * h > 50) & (w * h < 600)], {})


def test_crop_edge(spark, lines):
    df, b, _ = lines
    crop, whole = np.array([0, 0, 60, 45]), np.array([0, 0, 180, 120])
    shift = np.stack([df.part % 3 * 40, df.supp % 3 * 30] * 2, axis=1)
    near = np.isclose(b, crop, rtol=0, atol=5) & ~np.isclose(b + shift, whole, rtol=0, atol=5)
    kept = ~near.any(axis=1)
    assert (near[:, 1] & ~near[:, [0, 2, 3]].any(axis=1)).any() and (near[:, 3] & ~near[:, :3].any(axis=1)).any()
    check(spark, shapes.q_crop_edge, df[kept], {})


def test_crop_and_overlap(spark, lines):
    df, b, _ = lines
    window = np.array([20.0, 10.0, 80.0, 70.0])
    centre = (b[:, :2] + b[:, 2:]) / 2
    inside = ((centre > window[:2]) & (centre < window[2:])).all(axis=1)
    clipped = np.clip(b[inside].reshape(-1, 2, 2), window[:2], window[2:]) - window[:2]
    check(spark, shapes.q_crop_boxes, df[inside], dict(zip(("cx1", "cy1", "cx2", "cy2"), clipped.reshape(-1, 4).T)))
    side = np.clip(np.minimum(b[:, 2:], window[2:]) - np.maximum(b[:, :2], window[:2]), 0, None)
    both = side.prod(axis=1)
    check(spark, shapes.q_relative_overlap, df, {"relative": both / 3600, "with_eps": both / ((b[:, 2:] - b[:, :2]).prod(axis=1) + 3600 - both + 1e-6)})


def test_union_box(spark, lines):
    df, b, _ = lines
    hull = np.concatenate([np.minimum(b[:, :2], 30) - 4, np.maximum(b[:, 2:], 50) + 4], axis=1)
    check(spark, shapes.q_union_box, df, dict(zip(("ux1", "uy1", "ux2", "uy2"), np.clip(hull, 0, 100).T)))


def test_box_coding(spark, lines):
    df, b, _ = lines
    size = b[:, 2:] - b[:, :2] + 1
    anchor_size, anchor = np.array([30.0, 50.0]), np.array([40.0, 45.0])
    t = np.concatenate([(b[:, :2] + size / 2 - anchor) / anchor_size * 10, np.log(size / anchor_size) * 5], axis=1)
    # decoding gives the boxes back
    check(spark, shapes.q_box_coding, df, dict(zip(("tx", "ty", "tw", "th", "bx1", "by1", "bx2", "by2"), np.concatenate([t, b], axis=1).T)), 4)


def test_cameras_and_projection(spark, lines):
    df, _, p = lines
    turn = np.deg2rad(np.stack([df.qty, df.part % 360], axis=1))
    direction = np.stack([np.cos(turn[:, 0]) * np.cos(turn[:, 1]), np.cos(turn[:, 0]) * np.sin(turn[:, 1]), np.sin(turn[:, 0])], axis=1)
    assert np.allclose(np.linalg.norm(direction, axis=1), 1)
    check(spark, shapes.q_camera_position, df, dict(zip(("ex", "ey", "ez"), 9.6 * direction.T)))
    camera = np.array([[50.0, 0, 32], [0, 50, 24], [0, 0, 1]])
    q = (p + [0, 0, 6]) @ camera.T
    # the principal point is added after the division
    uv = np.stack([(p[:, 0] * 50) / (p[:, 2] + 6) + 32, (p[:, 1] * 50) / (p[:, 2] + 6) + 24], axis=1)
    assert np.allclose(uv, q[:, :2] / q[:, 2:])
    uv = np.rint(uv)
    seen = (uv >= 0).all(axis=1) & (uv[:, 0] < 64) & (uv[:, 1] < 48)
    check(spark, shapes.q_projection, df[seen], {"u": uv[seen, 0], "v": uv[seen, 1]})


def product(a, b):
    """Of two quaternions (w, x, y, z)."""
    return np.concatenate([[a[0] * b[0] - a[1:] @ b[1:]], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])])


def test_turns(spark, lines):
    df, _, p = lines
    c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
    turned = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T
    check(spark, shapes.q_rotate_swap, df, dict(zip(("rx", "ry", "rz"), turned.T)) | {"sx": p[:, 0], "sy": -p[:, 2], "sz": p[:, 1]})
    part = pd.read_parquet(f"{DATA}/part.parquet")
    moving = df.part.isin(part.p_partkey[part.p_size > 25]).to_numpy()
    q = np.array([0.8, 0.6, 0, 0])
    back = q * [1, -1, -1, -1]
    out = np.array([product(product(q, np.concatenate([[0], v])), back)[1:] for v in p[moving]])
    check(spark, shapes.q_rotate_parts, df[moving], dict(zip(("qx", "qy", "qz"), out.T)))


def test_span_probing(spark, tmp_path):
    from sparktally.plans import records

    text = "ab cd  efg h " + "x" * 40
    spark.createDataFrame([(1, 0, text), (2, 0, "abc"), (3, 0, "0123456789 "), (4, 0, "")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.span): (r.first_token, r.last_token) for r in records.q_span_probing(spark, str(tmp_path)).collect()}
    # (1): chars 10..23 start in a space, the next is h (token 5); 40 is in the last token; 17..25 too. (2): 1..0 is empty, ends before it starts
    assert got == {(1, 0): (5, 6), (1, 1): (6, 6), (1, 2): (6, 6), (2, 2): (1, 1), (3, 2): (1, 1)}

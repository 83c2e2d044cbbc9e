"""Component and edge features against numpy."""

import numpy as np
import pytest

from sparktally.operators import superpoints


def features_by_numpy(xyz):
    """The features as they are defined, with numpy's eigenvalues."""
    u = np.unique(xyz, axis=0)
    if len(u) == 1:
        return u[0], 0.0, 0.0, 0.0
    if len(u) == 2:
        return u.mean(axis=0), np.sqrt(u.var(axis=0).sum()), 0.0, 0.0
    ev = -np.sort(-np.linalg.eigvalsh(np.cov(u.T)))
    return u.mean(axis=0), ev[0], np.sqrt(max(0, ev[0] * ev[1]) + 1e-10), np.sqrt(max(0, ev.prod()) + 1e-10)


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(6)
    made = {i: rng.normal(size=(rng.integers(4, 40), 3)) @ rng.normal(size=(3, 3)) + 1000 * rng.normal(size=3) for i in range(20)}
    made[30] = np.array([[1.0, 2, 3]] * 4)  # one point again and again
    made[31] = np.array([[1.0, 2, 3], [5, 2, 0], [1, 2, 3]])
    made[32] = np.array([[k, 2.0 * k, 0] for k in range(7)])  # a line
    made[33] = np.array([[x, y, 5.0] for x in range(3) for y in range(4)])  # a plane
    made[34] = np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]])  # the same all ways
    return made


def frame(spark, shapes):
    rows = [("s", k, *p) for k, v in shapes.items() for p in v.tolist()] + [("s", 0, None, 1.0, 1.0), ("s", 0, float("nan"), 1.0, 1.0)]
    return spark.createDataFrame(rows, "shape string, comp int, x double, y double, z double").repartition(4)


def test_component_features(spark, shapes):
    got = {r.comp: r for r in superpoints.component_features(frame(spark, shapes), ["shape", "comp"]).collect()}
    assert set(got) == set(shapes)
    for k, xyz in shapes.items():
        centre, length, surface, volume = features_by_numpy(xyz)
        r = got[k]
        assert r.n == len(xyz) and np.allclose([r.cx, r.cy, r.cz], centre) and np.isclose(r.length, length, rtol=1e-6)
        assert np.allclose([r.surface, r.volume], [surface, volume], rtol=1e-5, atol=1e-4 * max(1.0, length**1.5)), k


def test_edge_features(spark, shapes):
    rng = np.random.default_rng(7)
    pairs = []
    for _ in range(300):
        a, b = rng.choice(list(shapes), 2)
        p, q = shapes[a][rng.integers(len(shapes[a]))], shapes[b][rng.integers(len(shapes[b]))]
        pairs.append(("s", int(a), int(b), *p.tolist(), *q.tolist()))
    pairs += pairs[:20]
    edges = spark.createDataFrame(pairs, "shape string, source int, target int, ax double, ay double, az double, bx double, by_ double, bz double")
    features = superpoints.component_features(frame(spark, shapes), ["shape", "comp"])
    got = {(r.source, r.target): r for r in superpoints.edge_features(edges, features, ["shape"], 900.0).collect()}
    want = {}
    for _, a, b, *p in set(pairs):
        delta = np.array(p[:3]) - np.array(p[3:])
        if a != b and np.linalg.norm(delta) < 900:
            want.setdefault((a, b), []).append(delta)
    assert set(got) == set(want) and len(want) > 5
    for (a, b), deltas in want.items():
        r, d = got[(a, b)], np.array(deltas)
        (ca, la, _, _), (cb, lb, _, _) = features_by_numpy(shapes[a]), features_by_numpy(shapes[b])
        assert r.n == len(d) and np.allclose([r.dx, r.dy, r.dz], d.mean(axis=0)) and np.allclose([r.sx, r.sy, r.sz], d.std(axis=0), atol=1e-6)
        assert np.isclose(r.norm, np.linalg.norm(d, axis=1).mean()) and np.allclose([r.cx, r.cy, r.cz], ca - cb)
        assert np.isclose(r.length_ratio, la / (lb + 1e-6), rtol=1e-4) and np.isclose(r.n_ratio, len(shapes[a]) / (len(shapes[b]) + 1e-6))
    assert superpoints.component_features(frame(spark, shapes).limit(0), ["comp"]).count() == 0

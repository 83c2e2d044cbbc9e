"""Suppression, voting and label-aware samples against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktally.operators import farthest, suppression

SCHEMA = "g string, id long, score double, x1 double, y1 double, x2 double, y2 double"


def over(a, b, pixel):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + pixel, min(a[3], b[3]) - max(a[1], b[1]) + pixel
    both = max(0.0, w) * max(0.0, h)
    size = lambda t: (t[2] - t[0] + pixel) * (t[3] - t[1] + pixel)
    return round(both / (size(a) + size(b) - both), 9) if size(a) + size(b) - both else 0.0


def kept_by_force(rows, least, pixel, strict):
    out = {}
    for g, i, s, *box in sorted((r for r in rows if None not in r), key=lambda r: (-r[2], r[1])):
        own = out.setdefault(g, [])
        if not any((over(b, box, pixel) > least if strict else over(b, box, pixel) >= least) for _, b in own):
            own.append((i, box))
    return {(g, i) for g, v in out.items() for i, _ in v}


def made(seed, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.integers(-40, 200, 2)
        w, h = (2 ** rng.uniform(0, 6, 2)).round(1)
        rows.append((f"g{i % 3}", i, float(rng.integers(0, 40)), float(x), float(y), float(x + w), float(y + h)))
    rows += [("g0", 1000 + i, float(i % 7), 50 + i % 5 * 0.5, 50.0, 80.0 + i % 3, 90.0) for i in range(150)]  # a heap of near-copies
    rows += [("g1", 2000 + i, 3.0, 10.0, 10.0, 20.0, 20.0) for i in range(40)]  # copies
    return rows + [("g1", 3000, 5.0, 7.0, 7.0, 7.0, 7.0), ("g1", 3001, 4.0, 7.0, 7.0, 7.0, 7.0), ("lone", 3002, 1.0, 0.0, 0.0, 5.0, 5.0), ("g2", 3003, 9.0, None, 0.0, 1.0, 1.0)]


def ranked(spark, rows):
    rank = F.struct((-F.col("score")).alias("s"), "id")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("rank", F.when(F.col("score").isNotNull(), rank))


@pytest.mark.parametrize("least,pixel,strict,crowd", [(0.3, 0.0, False, 64), (0.3, 1.0, False, 2), (0.5, 0.0, True, 8), (0.9, 1.0, True, 64), (1.0, 0.0, False, 64)])
def test_suppress(spark, least, pixel, strict, crowd):
    rows = made(3)
    got = suppression.suppress(ranked(spark, rows), ["g"], least, pixel, strict, crowd)
    assert {(r.g, r["rank"]["id"]) for r in got.collect()} == kept_by_force(rows, least, pixel, strict)


def test_an_image_of_ten_thousand_boxes(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 2000, (2, 10_000))
    w, h = rng.integers(10, 60, (2, 10_000))
    box = np.stack([x, y, x + w, y + h], axis=1).astype(float)
    rows = [("one", i, float(s), *b) for i, (s, b) in enumerate(zip(rng.permutation(10_000), box.tolist()))]
    left, want = np.argsort([-r[2] for r in rows]), set()
    while len(left):
        a, b = box[left[0]], box[left]
        want.add(int(left[0]))
        both = np.maximum(0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])) * np.maximum(0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))
        size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        left = left[both / (size[0] + size - both) <= 0.3]
    got = suppression.suppress(ranked(spark, rows), ["g"], 0.3, strict=True)
    assert {r["rank"]["id"] for r in got.collect()} == want
    assert suppression.suppress(ranked(spark, rows[:1]).limit(0), ["g"], 0.3).count() == 0


@pytest.mark.parametrize("soft", [None, 4.0])
def test_vote(spark, soft):
    rows = made(5, 200)
    want = {}
    for g in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == g and None not in r), key=lambda r: (-r[2], r[1]))
        if len(left) < 2:
            continue
        while left:
            seed = left[0]
            own = [r for r in left if over(seed[3:], r[3:], 1.0) >= 0.5]
            left = [r for r in left if r not in own]
            total = sum(r[2] for r in own)
            box = [sum(r[k] * r[2] for r in own) / total if total else seed[k] for k in range(3, 7)]
            want[(g, seed[1], None)] = (len(own), *[round(v, 6) for v in box], seed[2])
            for r in own if soft and len(own) > 1 else ():
                score = r[2] * (1 - over(seed[3:], r[3:], 1.0))
                if score >= soft:
                    want[(g, seed[1], r[1])] = (len(own), *r[3:], round(score, 6))
    got = suppression.vote(ranked(spark, rows), ["g"], 0.5, 1.0, soft).collect()
    assert len(got) == len(want)
    assert {(r.g, r.seed["id"], r["rank"] and r["rank"]["id"]): (r.n, *[round(r[c], 6) for c in ("x1", "y1", "x2", "y2", "score")]) for r in got} == want


def by_loop(points, k, least, start):
    """Farthest points one by one, all distances anew."""
    out = list(start)
    n0 = len(out)
    while len(out) - n0 < k and len(out) < len(points) + 0:
        left = [i for i in range(len(points)) if i not in out]
        if not left:
            break
        dist = lambda i: min([sum((a - b) ** 2 for a, b in zip(points[i], points[j])) for j in out], default=float("inf"))
        out.append(max(left, key=lambda i: (dist(i), -i)))
    return out[n0:]


@pytest.mark.parametrize("total", [5, 20, 100])
def test_label_quota(total):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 15, (60, 3)).astype(float)
    label = rng.integers(0, 6, 60)
    label[:2] = 9  # a label of two points
    first = np.arange(60)
    chosen = []
    for name in np.unique(label):
        own = np.flatnonzero(label == name)
        chosen += own[by_loop(points[own].tolist(), 3, None, [])].tolist()
    if len(chosen) > total:
        part = np.array(chosen)
        want = set(sorted_by_first(points, part, total))
    else:
        want = set(chosen) | set(by_loop(points.tolist(), total - len(chosen), None, chosen))
    assert set(farthest.label_quota(points, label, first, total, 3).tolist()) == want


def sorted_by_first(points, part, total):
    part = np.sort(part)
    return part[by_loop(points[part].tolist(), total, None, [])].tolist()


def test_label_aware_sample_of_edge_rows(spark):
    rows = [("a", i, "l", float(i), 0.0, 0.0) for i in range(4)] + [("a", 9, None, 1.0, 0.0, 0.0), ("a", None, "l", 1.0, 0.0, 0.0), ("a", 10, "m", None, 0.0, 0.0), ("b", 11, "m", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud string, id long, label string, x double, y double, z double")
    got = {(r.cloud, r.id, r.label) for r in farthest.label_aware_sample(df, ["cloud"], 10, 2).collect()}
    assert got == {("a", i, "l") for i in range(4)} | {("b", 11, "m")}
    assert farthest.label_aware_sample(df.limit(0), ["cloud"], 10, 2).count() == 0


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("total, least", [(9, 3), (30, 1), (4, 0), (0, 2)])
def test_many_clouds_at_once(total, least, apart):
    """As each cloud by itself: clouds of one point, of equal points, of many labels, and larger ones."""
    rng = np.random.default_rng(6)
    sizes = [1, 40, 2, 300, 7, 25, 25, 90]
    cloud = np.repeat(np.arange(len(sizes)), sizes)
    points, label = rng.integers(0, 9, (3, len(cloud))).astype(float), rng.integers(0, 5, len(cloud))
    points[:, cloud == 5] = 2.0
    label[cloud == 6] = np.arange(25)
    want = [np.flatnonzero(cloud == c)[np.sort(farthest.label_quota(points[:, cloud == c].T, label[cloud == c], np.arange(n), total, least, apart))] for c, n in enumerate(sizes)]
    assert farthest.label_quota_each(points, cloud, label, total, least, apart).tolist() == np.concatenate(want).tolist()


def test_clouds_over_several_batches(spark):
    """Clouds begin and end anywhere in a batch; keys of any size stay, a null one too, and no group goes to Python by itself."""
    made = [(None if i % 7 == 0 else f"c{i % 7 % 5}", (1 << 60) + i, f"l{i % 4}", float(i * 37 % 101), float(i * 11 % 23), float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(made, "cloud string, id long, label string, x double, y double, z double")
    found = farthest.label_aware_sample(df, ["cloud"], 10, 2)
    want, key = {}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    for c in {r[0] for r in made}:
        own = sorted((r for r in made if r[0] == c), key=lambda r: hashlib.md5(str(r[1]).encode()).hexdigest())
        at = farthest.label_quota(np.array([r[3:] for r in own]), np.array([r[2] for r in own]), np.arange(len(own)), 10, 2)
        want |= {(c, own[i][1]): own[i][2] for i in at}
    usual = spark.conf.get(key)
    for rows in ("7", "1", usual):
        spark.conf.set(key, rows)
        assert {(r.cloud, r.id): r.label for r in found.collect()} == want and found.count() == len(want) == 60
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()

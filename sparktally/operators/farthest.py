"""Farthest-point samples of point clouds: many small clouds at once in arrays, a large one by itself (24 bytes a point and some)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def squared(gap: np.ndarray) -> np.ndarray:
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def farthest_each(points: np.ndarray, group: np.ndarray, most: int | np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Positions of up to ``most`` points of each group, each the farthest from those before, of equal ones the first.

    points: rows x, y, z; group: a number from 0 for each point; most: one number for all groups, or one for each. least: squared
    distances to points that are chosen already; without it a group begins with its first point. Groups that want many points
    are laid before those that want few, and the running least distances are kept: a step costs one pass over the groups
    that still want points.
    """
    size = np.bincount(group, minlength=np.size(most) if np.ndim(most) else 0)
    want = np.minimum(size, most)
    rank = np.argsort(-want, kind="stable")
    place = np.empty(len(rank), int)
    place[rank] = np.arange(len(rank))
    order = np.argsort(place[group], kind="stable")
    size, want = size[rank], want[rank]
    start = np.cumsum(size) - size
    points = np.ascontiguousarray(points[:, order])
    least = np.full(len(group), np.inf) if least is None else least[order]
    out = [np.empty(0, int)]
    for step in range(int(want.max(initial=0))):
        g = int(np.searchsorted(-want, -step))
        n = int(start[g - 1] + size[g - 1])
        at = np.flatnonzero(least[:n] == np.repeat(np.maximum.reduceat(least[:n], start[:g]), size[:g]))
        pick = at[np.searchsorted(at, start[:g])]
        out.append(order[pick])
        least[:n] = np.minimum(least[:n], squared(points[:, :n] - np.repeat(points[:, pick], size[:g], axis=1)))
        least[pick] = -1.0
    return np.concatenate(out)


def label_quota_each(points: np.ndarray, cloud: np.ndarray, label: np.ndarray, total: int, least: int, apart: bool = True) -> np.ndarray:
    """Positions of a sample of each cloud with up to ``least`` points of each label, filled up or cut down to ``total``.

    points: rows x, y, z; cloud: numbers from 0, ascending; label: numbers from 0. Ties and starts go by the points' order.
    apart: what fills it up is far from what is chosen already; otherwise from its own first point on.
    """
    chosen = np.zeros(len(cloud), bool)
    chosen[farthest_each(points, np.unique(cloud * (int(label.max(initial=0)) + 1) + label, return_inverse=True)[1], least)] = True
    taken = np.bincount(cloud[chosen], minlength=int(cloud.max(initial=-1)) + 1)
    over = np.flatnonzero(chosen & (taken > total)[cloud])
    rest = np.flatnonzero(~chosen & (taken < total)[cloud])
    near = np.full(len(rest), np.inf)
    if apart:
        own, own_first = np.flatnonzero(chosen), np.cumsum(taken) - taken
        left, j = np.arange(len(rest)), 0
        while len(left := left[taken[cloud[rest[left]]] > j]):
            at = own[own_first[cloud[rest[left]]] + j]
            near[left] = np.minimum(near[left], squared(points[:, rest[left]] - points[:, at]))
            j += 1
    chosen[over] = False
    chosen[over[farthest_each(points[:, over], cloud[over], total)]] = True
    chosen[rest[farthest_each(points[:, rest], cloud[rest], np.maximum(total - taken, 0), near)]] = True
    return np.flatnonzero(chosen)


def label_quota(points: np.ndarray, label: np.ndarray, first: np.ndarray, total: int, least: int, apart: bool = True) -> np.ndarray:
    """label_quota_each() of one cloud of rows (x, y, z), whose ties and starts go by the order ``first``."""
    order = np.argsort(first, kind="stable")
    names = np.unique(label, return_inverse=True)[1]
    return order[label_quota_each(points[order].T, np.zeros(len(order), int), names[order], total, least, apart)]


def label_aware_sample(points: DataFrame, by: list[str], total: int, least: int, apart: bool = True) -> DataFrame:
    """(by, id, label) of a sample of each cloud: ``least`` points of each label as far as there are, then the farthest, ``total`` in all.

    points: by, id (unique in a cloud), label, x, y, z. Starts are by a hash of the id, ties too. Points with a null id, label or a
    non-finite coordinate aren't sampled. A cloud smaller than ``total`` is taken whole. Clouds follow each other sorted by
    hash; the clouds that end in an Arrow batch are sampled at once, and one task holds one cloud's coordinates besides.
    """
    ok = points.where("id is not null and label is not null")
    for a in "xyz":
        ok = ok.where(F.col(a).isNotNull() & (F.abs(F.col(a)) < float("inf")) & ~F.isnan(F.col(a).cast("double")))
    ok = ok.select(*by, "id", "label", F.md5(F.col("id").cast("string")).alias("place"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    ok = ok.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place", "id"))).sortWithinPartitions(*by, "place", "id").drop("place")

    def sample(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        cloud = np.cumsum(rows["nth"].to_numpy() == 1) - 1
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy().astype(int)
        yield from rows.select([*by, "id", "label"]).take(pa.array(label_quota_each(np.stack([rows[a].to_numpy() for a in "xyz"]), cloud, label, total, least, apart))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if len(begins) and (held or begins[-1]):
                yield from sample([*held, batch.slice(0, begins[-1])])
                batch, held = batch.slice(begins[-1]), []
            held.append(batch)
        if held:
            yield from sample(held)

    kind = {f.name: f.dataType.simpleString() for f in ok.schema.fields}
    return ok.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in [*by, "id", "label"]))

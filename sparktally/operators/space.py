"""Points, boxes, triangles and rays in space: joins by the cells of a uniform grid, exact whatever the cell's size.

Every function takes the names of the columns ``by`` that keep scenes apart (meshes, shapes, views). Rows with a null or
non-finite coordinate take part in nothing. A cell's size decides work, not results; it should be near the size of what is
looked for. Rows of one cell meet by an equi-join, which Spark can split where a cell is hot.

Scenes of few rows need no grid: they meet whole, scene by scene, and only scenes beyond a bound go by cells (crowded()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .graph import checkpointed

AXES = ("x", "y", "z")
Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    return tuple(F.col(prefix + a) for a in AXES)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def named(prefix: str, v: Vector) -> dict[str, Column]:
    return {prefix + a: x for a, x in zip(AXES, v, strict=True)}


def finite(df: DataFrame, *prefixes: str) -> DataFrame:
    """The rows whose coordinates are all numbers."""
    return df.where(reduce(lambda a, b: a & b, [F.col(p + a).isNotNull() & (F.abs(F.col(p + a)) < float("inf")) & ~F.isnan(F.col(p + a).cast("double")) for p in prefixes for a in AXES]))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def spread(df: DataFrame, size: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """A row for each cell (cx, cy, cz) that the closed box from lo<axis> to hi<axis> touches."""
    for a in axes:
        df = df.withColumn(f"c{a}", F.explode(F.sequence(cell(F.col(f"lo{a}"), size), cell(F.col(f"hi{a}"), size))))
    return df


def boxed(df: DataFrame, corners: str, margin: float) -> DataFrame:
    """With the box lo.. to hi.. around the points of the prefixes ``corners``."""
    return df.withColumns({f"lo{a}": F.least(*[F.col(p + a) for p in corners]) - margin for a in AXES} | {f"hi{a}": F.greatest(*[F.col(p + a) for p in corners]) + margin for a in AXES})


def crowded(sides: list[tuple[DataFrame, int]], by: list[str]) -> DataFrame | None:
    """The scenes with more rows than its bound in one of the tables; None if there are none. Counts alone are shuffled."""
    counts = [df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*by) for df, most in sides]
    large = checkpointed(reduce(DataFrame.union, counts).distinct())
    return None if large.isEmpty() else large


def parted(df: DataFrame, large: DataFrame | None, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the other scenes, and those of the ``large`` ones."""
    return (df, None) if large is None else (df.join(large, by, "left_anti"), df.join(large, by, "left_semi"))


def _nine(x: float) -> Decimal:
    return Decimal(repr(max(float(x), 0.0))).quantize(Decimal("1e-9"), ROUND_HALF_UP)


def first_least(values: np.ndarray) -> np.ndarray:
    """For each row the place of its least value, to nine places, of equal ones the first."""
    at = values.argmin(axis=1)
    least = values[np.arange(len(values)), at][:, None]
    close = (values <= least + 1.1e-9) & np.isfinite(values)
    for i in np.nonzero((close & (values > least)).any(axis=1))[0]:
        at[i] = min(np.nonzero(close[i])[0].tolist(), key=lambda j: (_nine(values[i, j]), j))
    return at


def gathered(df: DataFrame, by: list[str], name: str, *columns: str) -> DataFrame:
    """(by, name): each scene's rows as one array of structs, in the order of the first column."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def flat(name: str, *columns: str) -> Column:
    return F.flatten(F.transform(name, lambda s: F.array(*[s[c] for c in columns])))


# ------------------------------------------------------------------------------------------------- rays


@F.pandas_udf(StructType().add("tri", ArrayType(IntegerType())).add("t", ArrayType(DoubleType())))
def _first_hits(rays: pd.Series, tris: pd.Series) -> pd.DataFrame:
    """For each ray of a scene (o, d) the place of the triangle (a, b, c) that it hits first, or -1, and where."""
    out = []
    for r, t in zip(rays, tris, strict=True):
        r, t = r.reshape(-1, 6), t.reshape(-1, 9)
        a, e, f = t[:, 0:3].T, (t[:, 3:6] - t[:, 0:3]).T, (t[:, 6:9] - t[:, 0:3]).T
        places, far = np.full(len(r), -1, np.int32), np.full(len(r), np.nan)
        step = max(1, (1 << 16) // max(1, len(t)))
        for i in range(0, len(r), step):
            o, d = (r[i : i + step, k : k + 3].T[:, :, None] for k in (0, 3))
            s = o - a[:, None, :]
            p, q = cross(d, f), cross(s, e)
            det = dot(e, p)
            with np.errstate(all="ignore"):
                u, v, at = dot(s, p) / det, dot(d, q) / det, dot(f, q) / det
                hit = (np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (at > -5e-10)
            at = np.where(hit, at, np.inf)
            best = first_least(at)
            found = hit.any(axis=1)
            places[i : i + step] = np.where(found, best, -1)
            far[i : i + step] = np.where(found, at[np.arange(len(best)), best], np.nan)
        out.append((places, far))
    return pd.DataFrame(out, columns=["tri", "t"])


def walk(rays: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a ray (o.. + t d.., t >= 0) passes through within its scene's box lo.. to hi..

    A ray's crossings with the planes between cells are sorted; the middle of each piece between two names its cell.
    """
    some = lambda a, far: F.when(F.col(f"d{a}") != 0, (F.col(far) - F.col(f"o{a}")) / F.col(f"d{a}"))
    in_, out = [], []
    for a in AXES:
        near, far = some(a, f"lo{a}"), some(a, f"hi{a}")
        misses = (F.col(f"d{a}") == 0) & ((F.col(f"o{a}") < F.col(f"lo{a}")) | (F.col(f"o{a}") > F.col(f"hi{a}")))
        in_.append(F.when(misses, F.lit(float("inf"))).otherwise(F.least(near, far)))
        out.append(F.greatest(near, far))
    rays = rays.withColumn("t0", F.greatest(F.lit(0.0), *in_)).withColumn("t1", F.least(*out)).where("t0 <= t1")

    def crossings(a: str) -> Column:
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        p, q = o + d * F.col("t0"), o + d * F.col("t1")
        first, last = F.ceil(F.least(p, q) / size), F.floor(F.greatest(p, q) / size)
        planes = F.when((d != 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(planes, lambda k: F.greatest(F.col("t0"), F.least(F.col("t1"), (k * size - o) / d)))

    cuts = F.array_sort(F.concat(F.array("t0"), *[crossings(a) for a in AXES], F.array("t1")))
    rays = rays.withColumn("cuts", cuts)
    middle = lambda i: (F.get("cuts", i) + F.get("cuts", i + 1)) / 2
    at = lambda i: F.struct(*[cell(F.col(f"o{a}") + F.col(f"d{a}") * middle(i), size).alias(f"c{a}") for a in AXES])
    cells = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), at))
    return rays.withColumn("c", F.explode(cells)).select("*", "c.*").drop("c", "cuts", "t0", "t1")


def nearest_hits(rays: DataFrame, triangles: DataFrame, by: list[str], size: float, few: int = 2048, misses: bool = False) -> DataFrame:
    """(by, ray, tri, t): the first triangle that each ray hits, at o + t d; rays that hit nothing give no row (``misses``: nulls).

    rays: by, ray, o.., d..; triangles: by, tri, a.., b.., c... Triangles count from both sides and with their edges; of equal
    distances (to nine places) the smaller tri is taken. Degenerate triangles, and those in a ray's own plane, aren't hit;
    a ray without direction hits nothing. In scenes of at most ``few`` triangles and rays each ray meets all triangles; in others
    triangles are spread over the cells of their boxes, and rays walk the grid. Rays are unique in a scene.
    """
    corners, ends = [p + a for p in "abc" for a in AXES], [p + a for p in "od" for a in AXES]
    tris = finite(triangles, "a", "b", "c").select(*by, "tri", *[F.col(c).cast("double").alias(c) for c in corners])
    r = (rays if misses else finite(rays, "o", "d")).select(*by, "ray", *[F.col(c).cast("double").alias(c) for c in ends])
    large = crowded([(tris, few), (r, few)], by)
    (tris, far_tris), (r, far_rays) = parted(tris, large, by), parted(r, large, by)
    met = gathered(r, by, "rays", "ray", *ends).join(gathered(tris, by, "tris", "tri", *corners), by, "left" if misses else "inner")
    # a coordinate that is no number makes a ray without direction
    ok = F.transform("rays", lambda x: F.struct(*[F.when(reduce(lambda a, b: a & b, [x[c].isNotNull() & (F.abs(x[c]) < float("inf")) for c in ends]), x[c]).otherwise(0.0).alias(c) for c in ends]))
    met = met.withColumn("tris", F.coalesce("tris", F.array().cast(met.schema["tris"].dataType))).withColumn("ok", ok)
    met = met.withColumn("hit", _first_hits(flat("ok", *ends), flat("tris", *corners)))
    at = F.arrays_zip(F.transform("rays", lambda x: x["ray"]).alias("ray"), F.col("hit.tri").alias("at"), F.col("hit.t").alias("t"))
    one = F.transform(at, lambda x: F.struct(x["ray"].alias("ray"), F.when(x["at"] >= 0, F.get("tris", x["at"])["tri"]).alias("tri"), F.when(x["at"] >= 0, F.round(x["t"], 9)).alias("t")))
    near = met.select(*by, F.inline(one))
    near = near if misses else near.where("t is not null")
    if large is None:
        return near
    hits = _grid_hits(finite(far_rays, "o", "d"), far_tris, by, size)
    return near.unionByName(far_rays.select(*by, "ray").join(hits, [*by, "ray"], "left") if misses else hits)


def _grid_hits(r: DataFrame, tris: DataFrame, by: list[str], size: float) -> DataFrame:
    t = boxed(tris, "abc", 1e-9 * size)
    scene = t.groupBy(*by).agg(*[F.min(f"lo{a}").alias(f"lo{a}") for a in AXES], *[F.max(f"hi{a}").alias(f"hi{a}") for a in AXES])
    r = walk(r.join(scene, by), size).drop(*[f"{e}{a}" for e in ("lo", "hi") for a in AXES])
    cells = [f"c{a}" for a in AXES]
    # the corner c and the cell's cx, cy, cz would share their names
    t = spread(t.withColumnsRenamed({f"c{a}": f"k{a}" for a in AXES}), size)
    pairs = r.join(t, [*by, *cells])
    a, o, d = vector("a"), vector("o"), vector("d")
    e1, e2 = minus(vector("b"), a), minus(vector("k"), a)
    pairs = pairs.withColumns(named("e", e1) | named("f", e2) | named("s", minus(o, a)))
    e1, e2, s = vector("e"), vector("f"), vector("s")
    pairs = pairs.withColumns(named("p", cross(d, e2)) | named("q", cross(s, e1)))
    p, q = vector("p"), vector("q")
    pairs = pairs.withColumn("det", dot(e1, p)).where(F.abs("det") > 1e-12)
    pairs = pairs.withColumns({"u": dot(s, p) / F.col("det"), "v": dot(d, q) / F.col("det"), "t": F.round(dot(e2, q) / F.col("det"), 9)})
    hits = pairs.where("u >= 0 and v >= 0 and u + v <= 1 and t >= 0")
    best = hits.groupBy(*by, "ray").agg(F.min(F.struct("t", "tri")).alias("b"))
    return best.select(*by, "ray", "b.tri", "b.t")


# ------------------------------------------------------------------------------------------------- surfaces


def _to_segment(p: Vector, a: Vector, b: Vector) -> Column:
    """Squared distance of a point from a segment, which may be a point."""
    ab, ap = minus(b, a), minus(p, a)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(ap, ab), dot(ab, ab)))), F.lit(0.0))
    return sum(((x - t * y) * (x - t * y) for x, y in zip(ap, ab, strict=True)), F.lit(0.0))


def with_distance(df: DataFrame) -> DataFrame:
    """With ``d2``: the squared distance of point p.. from triangle a.., b.., k.., which may be degenerate."""
    p, a, b, c = (vector(x) for x in "pabk")
    df = df.withColumns(named("n", cross(minus(b, a), minus(c, a))))
    n = vector("n")
    sides = [dot(cross(minus(y, x), minus(p, x)), n) >= 0 for x, y in ((a, b), (b, c), (c, a))]
    inside = (dot(n, n) > 0) & sides[0] & sides[1] & sides[2]
    plane = dot(minus(p, a), n)
    d2 = F.when(inside, plane * plane / dot(n, n)).otherwise(F.least(_to_segment(p, a, b), _to_segment(p, b, c), _to_segment(p, c, a)))
    return df.withColumn("d2", d2).drop("nx", "ny", "nz")


def most_rounded(most: float) -> float:
    """The greatest number that, rounded to nine places, is at most ``most``."""
    above = Decimal(repr(float(most))).quantize(Decimal("1e-9"), ROUND_FLOOR) + Decimal("5e-10")
    at = float(above)
    return at if Decimal(repr(at)) < above else float(np.nextafter(at, -np.inf))


def square_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """with_distance() on arrays of three rows x, y, z: of each point p from its own triangle a, b, c."""

    def segment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ab, ap = b - a, p - a
        t = np.fmax(0.0, np.fmin(1.0, dot(ap, ab) / dot(ab, ab)))
        return dot(ap - t * ab, ap - t * ab)

    with np.errstate(all="ignore"):
        n = cross(b - a, c - a)
        nn = dot(n, n)
        inside = nn > 0
        for x, y in ((a, b), (b, c), (c, a)):
            inside &= dot(cross(y - x, p - x), n) >= 0
        plane = dot(p - a, n)
        return np.where(inside, plane * plane / nn, np.fmin(np.fmin(segment(a, b), segment(b, c)), segment(c, a)))


def on_faces(triangles: DataFrame, facets: DataFrame, by: list[str], tol: float, size: float, few: int = 512) -> DataFrame:
    """(by, face, tri): the triangles all of whose corners lie within ``tol`` of a face.

    triangles: by, tri, a.., b.., c..; facets: by, face, a.., b.., c..; tri and face are of a plain type, not structs or arrays. A face
    is any number of facets, and corners may be near different ones. In scenes of at most ``few`` triangles and facets all corners meet all facets' boxes, wider by the tolerance,
    and distances are worked out in arrays for the pairs that are left. In larger ones the boxes are spread over cells; a
    corner lies in one cell, so no pair meets twice. A corner beyond the box is beyond the tolerance.
    """
    corners = [p + a for p in "abc" for a in AXES]
    # counted before any other column is needed, so that keys alone are shuffled
    large = crowded([(triangles, few), (facets, few)], by)
    t, f = (finite(df, "a", "b", "c").select(*by, name, *[F.col(c).cast("double").alias(c) for c in corners]) for df, name in ((triangles, "tri"), (facets, "face")))
    (t, far_t), (f, far_f) = parted(t, large, by), parted(f, large, by)
    whole = lambda df, key, name: df.groupBy(*by).agg(F.collect_list(F.struct(F.col(key).alias("key"), *corners)).alias(name))
    met = whole(t, "tri", "tris").join(whole(f, "face", "facets"), by)
    kind = {c.name: c.dataType.simpleString() for c in [*t.schema.fields, *f.schema.fields]}
    near = met.mapInArrow(_faces_met(by, tol), ", ".join(f"{c} {kind[c]}" for c in [*by, "face", "tri"]))
    return near if large is None else near.unionByName(_faces_by_cells(far_t, far_f, by, tol, size))


def _faces_met(by: list[str], tol: float, pairs: int = 1 << 17) -> Callable:
    """From (by, tris, facets) to (by, face, tri), a batch of scenes at a time; distances of about ``pairs`` pairs at once."""
    most = most_rounded(tol * tol)
    margin = most**0.5 * (1 + 1e-9)

    def codes(*columns: pa.Array | np.ndarray) -> np.ndarray:
        """Equal numbers for equal rows."""
        out = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            c = c if isinstance(c, np.ndarray) else c.dictionary_encode(null_encoding="encode").indices.to_numpy()
            out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
        return out

    def sides(rows: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys, corners (row, corner, axis) and where each scene begins and ends."""
        flat = rows.flatten()
        return flat.field("key"), np.stack([flat.field(p + a).to_numpy() for p in "abc" for a in AXES], axis=1).reshape(-1, 3, 3), np.asarray(rows.offsets) - rows.offsets[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tri, corner, t_at = sides(batch.column("tris"))
            face, facet, f_at = sides(batch.column("facets"))
            scene, spot = np.repeat(np.arange(batch.num_rows), np.diff(t_at)), corner.reshape(-1, 3).T.copy()
            low, high, ends = facet.min(axis=1).T - margin, facet.max(axis=1).T + margin, np.ascontiguousarray(facet.transpose(1, 2, 0))
            near, held, n = [np.empty((2, 0), np.int64)], [], 0
            for k in range(batch.num_rows):
                i0, i1, j0, j1 = 3 * t_at[k], 3 * t_at[k + 1], f_at[k], f_at[k + 1]
                ok = np.ones((i1 - i0, j1 - j0), bool)
                for x in range(3):
                    p = spot[x, i0:i1, None]
                    ok &= (p >= low[x, j0:j1]) & (p <= high[x, j0:j1])
                i, j = np.nonzero(ok)
                held.append((i + i0, j + j0))
                n += len(i)
                if n >= pairs or k == batch.num_rows - 1:
                    i, j = (np.concatenate(side) for side in zip(*held, strict=True))
                    ok = square_distance(spot[:, i], *(ends[c][:, j] for c in range(3))) <= most
                    near.append(np.array([i[ok], j[ok]]))
                    held, n = [], 0
            i, j = np.concatenate(near, axis=1)
            if not len(i):
                continue
            own, name = codes(scene, tri), codes(face)
            key = own[i // 3] * (int(name.max()) + 1) + name[j]
            first = [np.unique(key[i % 3 == c], return_index=True) for c in range(3)]
            kept = reduce(np.intersect1d, [k for k, _ in first])
            at = np.flatnonzero(i % 3 == 0)[first[0][1][np.searchsorted(first[0][0], kept)]]
            of = pa.array(scene[i[at] // 3])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in by], face.take(pa.array(j[at])), tri.take(pa.array(i[at] // 3))], names=[*by, "face", "tri"])

    return run


def _faces_by_cells(t: DataFrame, f: DataFrame, by: list[str], tol: float, size: float) -> DataFrame:
    corner = lambda i, c: F.struct(F.lit(1 << i).alias("bit"), *[F.col(c + a).alias(f"p{a}") for a in AXES])
    points = t.select(*by, "tri", F.inline(F.array(*[corner(i, c) for i, c in enumerate("abc")])))
    points = points.withColumns({f"c{a}": cell(F.col(f"p{a}"), size) for a in AXES})
    f = spread(boxed(f, "abc", most_rounded(tol * tol) ** 0.5 * (1 + 1e-9)).withColumnsRenamed({f"c{a}": f"k{a}" for a in AXES}), size)
    near = with_distance(points.join(f, [*by, *[f"c{a}" for a in AXES]])).where(F.round("d2", 9) <= tol * tol)
    return near.groupBy(*by, "face", "tri").agg(F.bit_or("bit").alias("bits")).where("bits = 7").drop("bits")


# ------------------------------------------------------------------------------------------------- nearest point


def _box_distance(far: bool) -> Column:
    """Squared distance of the point from the nearest (or farthest) point of the box."""
    out = F.lit(0.0)
    for a in AXES:
        low, high = F.col(f"lo{a}") - F.col(f"q{a}"), F.col(f"q{a}") - F.col(f"hi{a}")
        gap = F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(F.lit(0.0), low, high)
        out = out + gap * gap
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _nearest(queries: pd.Series, base: pd.Series) -> pd.Series:
    """For each query of a scene the place of the point that is nearest."""
    out = []
    for q, b in zip(queries, base, strict=True):
        q, b = q.reshape(-1, 3), b.reshape(-1, 3).T
        step = max(1, (1 << 16) // b.shape[1])
        out.append(np.concatenate([first_least(sum(((b[k] - q[i : i + step, k, None]) ** 2 for k in range(3)), 0.0)) for i in range(0, len(q), step)]).astype(np.int32))
    return pd.Series(out, dtype=object)


def nearest_point(queries: DataFrame, base: DataFrame, by: list[str], size: float, few: int = 4096) -> DataFrame:
    """(by, qid, id, d2): each query's nearest point of ``base`` in its scene, exactly; ties go to the smaller id.

    queries: by, qid, x, y, z; base: by, id, x, y, z. qid is unique. Distances are squared and rounded to nine places. A query in a
    scene without points gives no row.

    In scenes of at most ``few`` points and queries each query meets all points, scene by scene in arrays. In larger ones
    cells double in size from level to level and know the box around their points. A query looks at the 27 cells about it,
    level by level, until one is occupied: the nearest point is then no farther than that cell's far corner, and so within
    the 27 cells two levels up. From there it descends into those cells alone that may hold a point nearer than the nearest
    far corner, down to points. A dense cluster far away is thus never met point by point.
    """
    points = finite(base, "").select(*by, "id", *[F.col(a).cast("double").alias(a) for a in AXES])
    asked = finite(queries, "").select(*by, "qid", *[F.col(a).cast("double").alias(f"q{a}") for a in AXES])
    large = crowded([(points, few), (asked, few)], by)
    (points, far_points), (asked, far_asked) = parted(points, large, by), parted(asked, large, by)
    q = [f"q{a}" for a in AXES]
    met = gathered(asked, by, "asked", "qid", *q).join(gathered(points, by, "points", "id", *AXES), by)
    met = met.withColumn("at", _nearest(flat("asked", *q), flat("points", *AXES)))

    def pair(x: Column, i: Column) -> Column:
        p = F.get("points", i)
        d2 = F.round(sum(((p[a] - x[f"q{a}"]) * (p[a] - x[f"q{a}"]) for a in AXES), F.lit(0.0)), 9)
        return F.struct(x["qid"].alias("qid"), p["id"].alias("id"), d2.alias("d2"))

    near = met.select(*by, F.inline(F.zip_with("asked", "at", pair)))
    return near if large is None else near.unionByName(_nearest_by_levels(far_asked, far_points, by, size))


def _nearest_by_levels(asked: DataFrame, points: DataFrame, by: list[str], size: float) -> DataFrame:
    at = [f"c{a}" for a in AXES]
    box = [f"{e}{a}" for e in ("lo", "hi") for a in AXES]
    points = points.withColumns({f"c{a}": cell(F.col(a), size) for a in AXES})
    asked = checkpointed(asked.withColumns({f"h{a}": cell(F.col(f"q{a}"), size) for a in AXES}))
    tight = [F.min(f"lo{a}").alias(f"lo{a}") for a in AXES] + [F.max(f"hi{a}").alias(f"hi{a}") for a in AXES]
    cells = [checkpointed(points.groupBy(*by, *at).agg(*[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES]))]
    up = lambda c, n: F.shiftright(F.col(c), n)
    widest = [F.max(F.abs(F.col(c))) for c in at]
    reach = [*cells[0].agg(*widest).first(), *asked.agg(*[F.max(F.abs(F.col(f"h{a}"))) for a in AXES]).first()]
    top = max([int(x or 0) for x in reach]).bit_length() + 1  # there all cells are next to each other

    def level(i: int) -> DataFrame:
        while len(cells) <= i:
            cells.append(checkpointed(cells[-1].groupBy(*by, *[up(c, 1).alias(c) for c in at]).agg(*tight)))
        return cells[i]

    def around(q: DataFrame, i: int) -> DataFrame:
        """Each query with the occupied ones of the 27 cells about it."""
        for a in AXES:
            h = up(f"h{a}", i)
            q = q.withColumn(f"c{a}", F.explode(F.array(h - 1, h, h + 1)))
        return q.join(level(i), [*by, *at])

    # up: the first level with something near
    found, left, last = [], asked, 0
    for i in range(top + 1):
        near = checkpointed(around(left, i).groupBy(*by, "qid").agg(F.min(_box_distance(True)).alias("most")))
        found.append(left.join(near, [*by, "qid"]))
        left = checkpointed(left.join(near, [*by, "qid"], "left_anti"))
        last = i
        if left.isEmpty():
            break
    # down: cells that may hold the nearest point
    now = None
    for i in range(min(last + 2, top), -1, -1):
        new = [q for k, q in enumerate(found) if min(k + 2, top) == i]
        parts = [around(q, i) for q in new] + ([now] if now is not None else [])
        if not parts:
            continue
        both = reduce(DataFrame.unionByName, parts).withColumn("own", _box_distance(True))
        least = both.groupBy(*by, "qid").agg(F.min("own").alias("own_most"))
        both = checkpointed(both.drop("own").join(least, [*by, "qid"]).withColumn("most", F.least("most", "own_most")).drop("own_most").where(_box_distance(False) <= F.col("most") * (1 + 1e-12)))
        if i:
            below = level(i - 1).select(*by, *[up(c, 1).alias(f"u{c}") for c in at], *at, *box)
            now = both.drop(*box).withColumnsRenamed({c: f"u{c}" for c in at}).join(below, [*by, *[f"u{c}" for c in at]]).drop(*[f"u{c}" for c in at])
        else:
            now = both.drop(*box)
    d2 = F.round(sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in AXES), F.lit(0.0)), 9)
    best = now.join(points, [*by, *at]).groupBy(*by, "qid").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("b"))
    return best.select(*by, "qid", "b.id", "b.d2")


# ------------------------------------------------------------------------------------------------- points in boxes


def inside_counts(points: DataFrame, boxes: DataFrame, by: list[str], size: float, piece: int = 4096, few: int = 4096) -> DataFrame:
    """(by, box, part, n): how many of each part's points lie strictly inside each box, where any do.

    points: by, part, x, y; boxes: by, box, x1, y1, x2, y2. In scenes of at most ``few`` points and boxes all points meet all boxes, and
    are counted where they meet. In larger ones: bins on two axes. A bin wholly inside a box is met as its counts by
    part; only bins on a box's border are met point by point, and one of more than ``piece`` different points is dealt out into
    pieces of about that size, each with its own copy of the bin's boxes.
    """
    flat = ("x", "y")
    ok = lambda df, *names: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) & ~F.isnan(F.col(c).cast("double")) for c in names]))
    points = ok(points, *flat).select(*by, "part", *flat)
    boxes = ok(boxes, "x1", "y1", "x2", "y2").where("x1 < x2 and y1 < y2").select(*by, "box", "x1", "y1", "x2", "y2")
    large = crowded([(points, few), (boxes, few)], by)
    (points, far_points), (boxes, far_boxes) = parted(points, large, by), parted(boxes, large, by)
    met = points.join(boxes, by).where("x > x1 and x < x2 and y > y1 and y < y2").groupBy(*by, "box", "part").agg(F.count("*").alias("n"))
    return met if large is None else met.unionByName(_binned_counts(far_points, far_boxes, by, size, piece))


def _binned_counts(points: DataFrame, boxes: DataFrame, by: list[str], size: float, piece: int) -> DataFrame:
    flat = ("x", "y")
    at = [cell(F.col(a), size).alias(f"c{a}") for a in flat]
    keys = [*by, "cx", "cy"]
    # equal points once, with their number, so that a bin's points can always be dealt out
    p = points.select(*by, "part", *flat, *at).groupBy(*keys, "part", *flat).agg(F.count("*").alias("n"))
    sums = p.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    hot = sums.groupBy(*keys).agg(F.sum("different").alias("different")).where(F.col("different") > piece).select(*keys, F.ceil(F.col("different") / piece).cast("int").alias("pieces"))
    b = boxes.select(*by, "box", "x1", "y1", "x2", "y2", *[F.col(f"{a}1").alias(f"lo{a}") for a in flat], *[F.col(f"{a}2").alias(f"hi{a}") for a in flat])
    b = spread(b, size, flat).drop(*[f"{e}{a}" for e in ("lo", "hi") for a in flat])
    whole = reduce(lambda x, y: x & y, [(F.col(f"{a}1") < F.col(f"c{a}") * size) & ((F.col(f"c{a}") + 1) * size <= F.col(f"{a}2")) for a in flat])
    inner = b.where(whole).join(sums, keys).select(*by, "box", "part", "n")
    some = F.coalesce("pieces", F.lit(1))
    border = b.where(~whole).join(hot, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), some - 1))).drop("pieces")
    dealt = p.join(hot, keys, "left").withColumn("piece", F.pmod(F.xxhash64("part", "x", "y"), some).cast("int")).drop("pieces")
    edge = border.join(dealt, [*keys, "piece"]).where("x > x1 and x < x2 and y > y1 and y < y2").groupBy(*by, "box", "part").agg(F.sum("n").alias("n"))
    return inner.unionByName(edge).groupBy(*by, "box", "part").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------------------------- points on a surface


def surface_points(triangles: DataFrame, by: list[str], each: float, unit: float = 1e-3) -> DataFrame:
    """(by, i, tri, x, y, z): points on the triangles of each mesh, one for about each ``each`` of its area, at least one.

    triangles: by, tri (unique in a mesh), a corner a.. and two edges u.., v... Sample i of n stands at (i + 1/2) / n of the line of all
    areas, in units of ``unit``, by tri; in its triangle it has a place by hash, evenly likely everywhere. Meshes without area
    give no points. A window sums the areas of a mesh; each triangle then knows its samples, without a join.
    """
    t = finite(triangles, "a", "u", "v")
    n = cross(vector("u"), vector("v"))
    t = t.withColumn("_area", F.round(F.sqrt(dot(n, n)) / 2 / unit).cast("long"))
    mesh = Window.partitionBy(*by)
    t = t.withColumns({"_lo": F.sum("_area").over(mesh.orderBy("tri")) - F.col("_area"), "_all": F.sum("_area").over(mesh)}).where("_area > 0")
    t = t.withColumn("_n", F.floor(F.col("_all") / F.lit(each / unit)) + 1)
    # the samples i with lo <= (i + 1/2) * all / n < lo + area, in whole numbers
    past = lambda at: F.greatest(F.lit(0).cast("long"), F.expr(f"(2 * _n * ({at}) - _all + 2 * _all - 1) div (2 * _all)"))
    t = t.withColumns({"_from": past("_lo"), "_to": past("_lo + _area")}).where("_from < _to")
    t = t.withColumn("i", F.explode(F.sequence("_from", F.col("_to") - 1)))
    name = F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.col("i").cast("string")))
    share = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("double") / 4294967296.0
    t = t.withColumns({"_r": F.sqrt(share(1)), "_h": share(9)})
    place = lambda a: F.col(f"a{a}") + F.col("_r") * (1 - F.col("_h")) * F.col(f"u{a}") + F.col("_r") * F.col("_h") * F.col(f"v{a}")
    return t.select(*by, "i", "tri", *[place(a).alias(a) for a in AXES])


# ------------------------------------------------------------------------------------------------- turns


def turned(p: Vector, roll: Column, yaw: Column, pitch: Column) -> Vector:
    """A point turned about x by ``roll``, then about y by ``yaw``, then about z by ``pitch`` (radians, counter-clockwise)."""
    x, y, z = p
    y, z = F.cos(roll) * y - F.sin(roll) * z, F.sin(roll) * y + F.cos(roll) * z
    x, z = F.cos(yaw) * x + F.sin(yaw) * z, F.cos(yaw) * z - F.sin(yaw) * x
    return F.cos(pitch) * x - F.sin(pitch) * y, F.sin(pitch) * x + F.cos(pitch) * y, z

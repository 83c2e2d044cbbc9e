"""Shape features of point components, and of the edges between neighbouring ones, from partial sums alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Added under the roots and to the divisors of the features; fixed values.
UNDER_ROOT, IN_RATIO = 1e-10, 1e-6


def _finite(df: DataFrame) -> DataFrame:
    for a in AXES:
        df = df.where(F.col(a).isNotNull() & (F.abs(F.col(a)) < float("inf")) & ~F.isnan(F.col(a).cast("double")))
    return df


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """With e1 >= e2 >= e3: the eigenvalues of the symmetric matrix xx, yy, zz, xy, xz, yz, in closed form."""
    c = F.col
    df = df.withColumn("_q", (c("xx") + c("yy") + c("zz")) / 3)
    spread = sum(((c(a) - c("_q")) * (c(a) - c("_q")) for a in ("xx", "yy", "zz")), F.lit(0.0)) + 2 * (c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz"))
    df = df.withColumn("_p", F.sqrt(spread / 6))
    x, y, z = ((c(a) - c("_q")) / c("_p") for a in ("xx", "yy", "zz"))
    xy, xz, yz = (c(a) / c("_p") for a in ("xy", "xz", "yz"))
    det = x * (y * z - yz * yz) - xy * (xy * z - yz * xz) + xz * (xy * yz - y * xz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    df = df.withColumn("_t", F.when(c("_p") > 0, turn).otherwise(0.0))
    df = df.withColumns({"e1": c("_q") + 2 * c("_p") * F.cos("_t"), "e3": c("_q") + 2 * c("_p") * F.cos(c("_t") + 2 * math.pi / 3)})
    return df.withColumn("e2", 3 * c("_q") - c("e1") - c("e3")).drop("_q", "_p", "_t")


def component_features(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, cx, cy, cz, length, surface, volume) of each component; ``by`` names it, with the shape it belongs to.

    points: by, x, y, z. n counts all points; the rest is of different points: one has no extent, two the root of their summed
    variances as length, three or more the largest eigenvalue of their covariance, and roots of the products of two
    and of three. Points with a null or non-finite coordinate don't count.
    """
    different = _finite(points).groupBy(*by, *AXES).agg(F.count("*").alias("n"))
    cov = [F.covar_samp(a, b).alias(a + b) for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))]
    sums = different.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("different"), *[F.avg(a).alias(f"c{a}") for a in AXES], *cov)
    e = with_eigenvalues(sums)
    # of two points the variance is half of that of the sample
    pair = F.sqrt((F.col("xx") + F.col("yy") + F.col("zz")) / 2)
    some = lambda of: F.when(F.col("different") > 2, of).otherwise(0.0)
    root = lambda *names: F.sqrt(F.greatest(F.lit(0.0), math.prod((F.col(x) for x in names), start=F.lit(1.0))) + UNDER_ROOT)
    length = F.when(F.col("different") == 2, pair).otherwise(some(F.col("e1")))
    return e.select(*by, "n", "cx", "cy", "cz", length.alias("length"), some(root("e1", "e2")).alias("surface"), some(root("e1", "e2", "e3")).alias("volume"))


def edge_features(edges: DataFrame, features: DataFrame, by: list[str], longest: float | None = None) -> DataFrame:
    """(by, source, target, n, d<axis>, s<axis>, norm, c<axis>, length_ratio, surface_ratio, volume_ratio, n_ratio) of each two components with an edge.

    edges: by, source, target, ax, ay, az, bx, by_, bz: pairs of points of two components, each way of its own. features:
    component_features() with the component in ``comp``. d, s: mean and spread of the differences (no spread of a single
    one), norm: their mean length, c: the difference of the centres. Edges of ``longest`` or more, and within a component, don't count;
    a pair of points that occurs again counts once.
    """
    ends = ("ax", "ay", "az", "bx", "by_", "bz")
    one = edges.where("source <> target").select(*by, "source", "target", *ends).distinct()
    one = one.select(*by, "source", "target", *[(F.col(a) - F.col(b)).alias(c) for a, b, c in zip(ends[:3], ends[3:], AXES, strict=True)])
    one = _finite(one).withColumn("far", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    if longest is not None:
        one = one.where(F.col("far") < longest)
    spread = lambda a: F.when(F.count("*") > 1, F.stddev_pop(a)).otherwise(0.0).alias(f"s{a}")
    out = one.groupBy(*by, "source", "target").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"d{a}") for a in AXES], *[spread(a) for a in AXES], F.avg("far").alias("norm"))
    values = ("n", "cx", "cy", "cz", "length", "surface", "volume")
    side = lambda name, p: features.select(*by, F.col("comp").alias(name), *[F.col(v).alias(p + v) for v in values])
    out = out.join(side("source", "s_"), [*by, "source"]).join(side("target", "t_"), [*by, "target"])
    ratio = lambda v: F.col(f"s_{v}") / (F.col(f"t_{v}") + IN_RATIO)
    centres: list[Column] = [(F.col(f"s_c{a}") - F.col(f"t_c{a}")).alias(f"c{a}") for a in AXES]
    return out.select(*by, "source", "target", "n", *[f"d{a}" for a in AXES], *[f"s{a}" for a in AXES], "norm", *centres, *[ratio(v).alias(f"{v}_ratio") for v in ("length", "surface", "volume", "n")])

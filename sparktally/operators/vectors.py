"""Exact vector search and pooling."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact_nearest(base: DataFrame, queries: DataFrame, k: int, block_rows: int = 2000, part_rows: int = 50_000, cells: int = 1 << 20) -> DataFrame:
    """(query_id, vec_id, score, rank) of each query's k rows of largest cosine in ``base``, itself excluded.

    Blocks of queries meet parts of the base in one cogroup, both of bounded size; each pair keeps k rows for a query,
    so that the last shuffle carries k rows for each query and part, and the plan is the same for any number of queries.
    Scores are rounded to nine places before ranking, so that ties don't hang on the order of additions; the smaller
    vec_id wins. Vectors that are null or zero take no part. A task holds ``cells`` scores at a time.
    """
    there = lambda df: df.where("embedding is not null").where(F.exists("embedding", lambda v: v != 0)).select("vec_id", "embedding")
    queries, base = there(queries), there(base)
    blocks, parts = (max(1, math.ceil(df.count() / rows)) for df, rows in ((queries, block_rows), (base, part_rows)))
    piece = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = queries.select("vec_id", "embedding", piece("block", blocks), every("part", parts))
    x = base.select("vec_id", "embedding", piece("part", parts), every("block", blocks))

    def best(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = (np.stack(df["embedding"]).astype(float) for df in (own, other))
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
        ids, names, out = own["vec_id"].to_numpy(), other["vec_id"].to_numpy(), []
        step = max(1, cells // len(b))
        for i in range(0, len(a), step):
            s = np.round(a[i : i + step] @ b.T, 9)
            s[ids[i : i + step, None] == names[None, :]] = -np.inf
            least = np.partition(s, -min(k, len(names)), axis=1)[:, -min(k, len(names))]
            r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            found = pd.DataFrame({"query_id": ids[i + r], "vec_id": names[c], "score": s[r, c]})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(found[found.groupby("query_id").cumcount() < k])
        return pd.concat(out)

    found = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInPandas(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """(key, i, mean, unit): each group's mean vector by component, and scaled to length 1; means are partial by task."""
    means = rows.select(key, F.posexplode("embedding").alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    size = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(key)))
    return means.select(key, "i", "mean", F.try_divide("mean", size).alias("unit"))

"""Exact top-k by inner product over vector-approximation files.

Vectors lie in shards of a bounded size. A shard's file keeps, for each component, the number of its cell (equally full
cells of the shard's own values) in place of the value. A query scans the cells: their edges bound its score with each
vector from both sides. Then exact vectors are read in the order of their bounds, best first, until the k-th best score
found can't be reached by the next bound. The shards' best are merged by query.

One sort brings a shard's vectors, then the queries, to a task, which holds the shard alone and lets queries pass in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Sums of products up to here are whole numbers in double precision.
SAFE = 2.0**53
MOST = 2**63 - 1
FOUND = ["query_id", "which", "vec_id", "score", "copies"]


class Approximation:
    """The cells of one shard's vectors (rows of whole numbers as doubles), and the edges of the cells."""

    def __init__(self, x: np.ndarray, bits: int = 4) -> None:
        self.x, cells = x, 1 << bits
        self.code = np.zeros(x.shape, np.uint8)
        self.low, self.high = np.zeros((x.shape[1], cells)), np.zeros((x.shape[1], cells))
        for j in range(x.shape[1]):
            order = np.sort(x[:, j])
            edges = np.unique(order[(np.arange(1, cells) * len(order)) // cells])
            self.code[:, j] = np.searchsorted(edges, x[:, j], side="right")
            # the least and the greatest value in each cell
            first = np.searchsorted(order, edges, side="left")
            starts, stops = np.concatenate([[0], first]), np.concatenate([first, [len(order)]])
            full = stops > starts
            self.low[j, np.flatnonzero(full)], self.high[j, np.flatnonzero(full)] = order[starts[full]], order[stops[full] - 1]

    def bounds(self, queries: np.ndarray, part: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's score with each vector, from cells alone."""
        plus, minus, dims = np.maximum(queries, 0), np.minimum(queries, 0), np.arange(self.code.shape[1])
        low, high = np.empty((len(queries), len(self.code))), np.empty((len(queries), len(self.code)))
        for a in range(0, len(self.code), part):
            code = self.code[a : a + part]
            lo, hi = self.low[dims, code].T, self.high[dims, code].T
            low[:, a : a + part], high[:, a : a + part] = plus @ lo + minus @ hi, plus @ hi + minus @ lo
        return low, high


def scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles while these hold them, else with whole numbers of any size."""
    if not x.size or float(np.abs(x).max()) < SAFE / max(1.0, float(np.abs(query).max())) / x.shape[1]:
        return x @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in x], object)


def search(file: Approximation, ids: np.ndarray, copies: np.ndarray, queries: np.ndarray, names: np.ndarray, k: int, step: int = 32) -> tuple[list[tuple], int]:
    """(query number, vec_id, score, copies) of each query's best rows in the shard, and how many exact vectors were read."""
    out, read = [], 0
    with np.errstate(over="ignore", invalid="ignore"):  # beyond double precision a bound is infinite
        slack = 1e-9 * (np.abs(queries).sum(axis=1) * (np.abs(file.x).max() if file.x.size else 0) + 1)  # rounding of the bounds
        lows, highs = file.bounds(queries)
        lows, highs = lows - slack[:, None], highs + slack[:, None]
    lows[np.isnan(lows)], highs[np.isnan(highs)] = -np.inf, np.inf
    lows, highs = np.clip(lows, -MOST, MOST), np.clip(highs, -MOST, MOST)
    for q, (query, name) in enumerate(zip(queries, names.tolist(), strict=True)):
        own = ids == name
        low, high = np.where(own, -np.inf, lows[q]), np.where(own, -np.inf, highs[q])
        n = len(ids) - int(own.sum())
        least = np.partition(low, len(low) - k)[len(low) - k] if n > k else -np.inf
        may = np.flatnonzero((high >= least) & ~own)
        may = may[np.argsort(-high[may], kind="stable")]
        best: list[tuple] = []
        for a in range(0, len(may), step):
            if len(best) >= k and best[k - 1][0] > high[may[a]]:
                break
            rows = may[a : a + step]
            read += len(rows)
            best += [(max(-MOST, min(MOST, int(s))), i, c) for s, i, c in zip(scores(file.x[rows], query).tolist(), ids[rows].tolist(), copies[rows].tolist(), strict=True)]
            best.sort(key=lambda b: (-b[0], b[1]))
            best = best[:k]
        out += [(q, i, s, c) for s, i, c in best]
    return out, read


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, copies): floor(scale * component) of the rows that take part; equal rows once, with their number."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite)
    return rows.select("vec_id", e.alias("x")).groupBy("vec_id", "x").agg(F.count("*").alias("copies"))


def top(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, bits: int = 4, shard_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` with the highest scores, but its own.

    score: the inner product of floor(scale * component); beyond 64 bits it is 2 ** 63 - 1 with its sign. Ties go to the smaller
    vec_id. Rows whose vec_id or embedding is null, or that hold null or non-finite components, take no part, as queries
    neither. Only vectors of equal length are compared. A repeated row is as many candidates, but one query; rows with
    the query's own id are its own. Rows of different vectors with one id are queries each by itself. Fewer candidates
    than k: all of them. Other columns, whatever their names, are ignored. No rows: none.
    """
    rows, asked = usable(vectors), usable(queries).withColumn("copies", F.lit(0).cast("long"))
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    here = F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int")
    both = rows.withColumn("shard", here).unionByName(asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    both = both.select("shard", F.size("x").alias("dim"), (F.col("copies") == 0).alias("asks"), "vec_id", "x", "copies", F.xxhash64("x").alias("which"))
    both = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, parts, ids, copies = None, None, [], None, None
        for batch in batches:
            keys = np.stack([batch["shard"].to_numpy(), batch["dim"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                (shard, dim, asks), own = keys[a].tolist(), batch.slice(a, b - a)
                if at != (shard, dim):
                    at, file, parts = (shard, dim), None, []
                x = np.floor(scale * own["x"].flatten().to_numpy(zero_copy_only=False).reshape(b - a, dim))
                name, many, which = (own[c].to_numpy() for c in ("vec_id", "copies", "which"))
                if not asks:
                    parts.append((x, name, many))
                    continue
                if file is None and parts:
                    ids, copies = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                    file, parts = Approximation(np.concatenate([p[0] for p in parts]), bits), []
                for c in range(0, len(x) if file else 0, 128):
                    hits, _ = search(file, ids, copies, x[c : c + 128], name[c : c + 128], k)
                    q = np.array([c + h[0] for h in hits], int)
                    columns = [name[q], which[q], *([h[i] for h in hits] for i in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=FOUND)

    found = both.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))
    copy = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long"))))
    found = found.select("query_id", "which", "vec_id", "score", copy.alias("copy"))
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top(rows, rows.where(F.col("vec_id") % 20 == 0))


#: The same rows in DuckDB: every query with every row.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

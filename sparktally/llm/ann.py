"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams.

Equal vectors share a node. Shards (by a hash of the vector) hold a bounded number of nodes; in each, greedy searches
propose neighbours and pruning with a relaxed distance keeps diverse ones. The graphs are written to the shared folder.
Queries pass every shard's graph in batches, from its medoid on; the shards' best are merged by score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

FAR = np.float32(np.inf)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """Out-neighbours of each node, -1 where there are fewer than ``degree``. Distance: 1 - cosine."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int) -> None:
        self.x, self.edges, self.entry = x, edges, entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and distances of each query's best ``beam`` found, nearest first; -1 and infinity beyond them."""
        n, rows = len(queries), np.arange(len(queries))
        ids, dist = np.full((n, beam), -1), np.full((n, beam), FAR, np.float32)
        ids[:, 0], dist[:, 0] = self.entry, 1 - queries @ self.x[self.entry]
        seen, open_ = np.zeros((n, len(self.x)), bool), np.zeros((n, beam), bool)
        seen[:, self.entry], open_[:, 0] = True, True
        active = rows
        while len(active):
            first = open_[active].argmax(axis=1)
            open_[active, first] = False
            near = self.edges[ids[active, first]]
            new = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            d = np.full(near.shape, FAR, np.float32)
            d[r, c] = 1 - np.einsum("ij,ij->i", queries[active[r]], self.x[near[r, c]])
            every_d = np.concatenate([dist[active], d], axis=1)
            every_i = np.concatenate([ids[active], np.where(new, near, -1)], axis=1)
            every_o = np.concatenate([open_[active], new], axis=1)
            best = np.argsort(every_d, axis=1, kind="stable")[:, :beam]
            at = np.arange(len(active))[:, None]
            ids[active], dist[active], open_[active] = every_i[at, best], every_d[at, best], every_o[at, best]
            active = active[open_[active].any(axis=1)]
        return ids, dist


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point the nearest candidate, then the nearest that no chosen one is ``relax`` times nearer to, and so on.

    candidates: node numbers by row, -1 for none; repeats and the point itself are ignored.
    """
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == points[:, None]] = -1
    vectors = x[order]
    d = np.where(order >= 0, 1 - np.einsum("pcd,pd->pc", vectors, x[points]), FAR)
    out, rows = np.full((len(points), degree), -1), np.arange(len(points))
    for k in range(degree):
        best = d.argmin(axis=1)
        some = d[rows, best] < FAR
        if not some.any():
            break
        out[some, k] = order[rows, best][some]
        between = 1 - np.einsum("pcd,pd->pc", vectors, vectors[rows, best])
        d[(relax * between <= d) & some[:, None]] = FAR
        d[rows, best] = FAR
    return out


def build(x: np.ndarray, degree: int = 24, beam: int = 48, relax: float = 1.2, batch: int = 256, seed: int = 1) -> Graph:
    """Two passes over all nodes in random order, the second with the relaxed distance."""
    n, rng = len(x), np.random.default_rng(seed)
    edges = np.full((n, degree), -1)
    some = min(degree // 2, n - 1)
    if some > 0:
        edges[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    graph = Graph(x, edges, int((x @ x.mean(axis=0)).argmax()))
    for alpha in (1.0, relax) if n > 1 else ():
        order = rng.permutation(n)
        for b in range(0, n, batch):
            points = order[b : b + batch]
            found, _ = graph.search(x[points], beam)
            edges[points] = prune(x, points, np.concatenate([found, edges[points]], axis=1), degree, alpha)
            target, source = edges[points].ravel(), np.repeat(points, degree)
            target, source = target[target >= 0], source[target >= 0]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            nodes, first, many = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(nodes), int(many.max())), -1)
            back[np.repeat(np.arange(len(nodes)), many), np.arange(len(target)) - np.repeat(first, many)] = source
            for a in range(0, len(nodes), 512):
                own = nodes[a : a + 512]
                both = np.concatenate([edges[own], back[a : a + 512]], axis=1)
                if (np.sort(both, axis=1)[:, : both.shape[1] - degree] < 0).all():
                    edges[own] = -np.sort(-both, axis=1)[:, :degree]
                else:
                    edges[own] = prune(x, own, both, degree, alpha)
    return graph


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: not null, finite, not zero."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(finite & F.exists(e, lambda v: v != 0)).select("vec_id", e.alias("embedding"))


def index(vectors: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, int]:
    """The graphs as a table (dim, shard, node, entry, ids, embedding, edges), and the number of shards.

    ids: the node's k + 1 smallest vec_ids; the ties of a longer list never are among the k nearest.
    """
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = usable(vectors).distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    nodes = nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes, "vectors")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    placed = nodes.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[x[0] for x in pdf["ids"]]).sort_values("least", ignore_index=True).drop(columns="least")
        graph = build(unit(np.stack(pdf["embedding"])))
        return pdf.assign(node=np.arange(len(pdf), dtype=np.int32), entry=np.int32(graph.entry), edges=[e[e >= 0].astype(np.int32) for e in graph.edges])

    graphs = placed.groupBy("dim", "shard").applyInPandas(run, "embedding array<double>, ids array<long>, dim int, shard int, node int, entry int, edges array<int>")
    return written(graphs, "graph"), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 96, shard_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors`` found, but itself.

    score: cosine in double precision on the original vectors; ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components take no part, as queries neither. Only vectors of equal length are
    compared. Repeated rows count once. Fewer candidates than k: all of them. Other columns, whatever their names, are
    ignored. No rows: none. A task holds a shard's graph while the queries pass in batches; graphs are never copied.
    """
    graphs, shards = index(vectors, k, shard_rows)
    asked = usable(queries).distinct()
    asked = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    both = graphs.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "node")

    def answers(q: pd.DataFrame, graph: Graph, x: np.ndarray, size: np.ndarray, ids: list[np.ndarray]) -> list[tuple]:
        own, out = np.stack(q["embedding"]), []
        found, _ = graph.search(unit(own), min(beam, len(x)))
        for me, v, hits in zip(q["vec_id"].astype("int64").tolist(), own, found, strict=True):
            hits = hits[hits >= 0]
            score = np.clip((x[hits] * v).sum(axis=1) / (size[hits] * np.linalg.norm(v)), -1.0, 1.0)
            best = sorted((-s, i) for h, s in zip(hits, score.tolist(), strict=True) for i in ids[h] if i != me)[:k]
            out += [(me, i, -s) for s, i in best]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, ready = None, [], None
        for pdf in batches:
            for (shard, dim, asks), own in pdf.groupby(["shard", "dim", "asks"], sort=True):
                if at != (shard, dim):
                    at, parts, ready = (shard, dim), [], None
                if not asks:
                    parts.append(own)
                    continue
                if ready is None and parts:
                    g, parts = pd.concat(parts, ignore_index=True), []
                    x, edges = np.stack(g["embedding"]), np.full((len(g), max(1, max(map(len, g["edges"])))), -1)
                    for i, e in enumerate(g["edges"]):
                        edges[i, : len(e)] = e
                    ready = Graph(unit(x), edges, int(g["entry"].iloc[0])), x, np.linalg.norm(x, axis=1), list(g["ids"])
                for a in range(0, len(own) if ready else 0, 256):
                    yield pd.DataFrame(answers(own.iloc[a : a + 256], *ready), columns=["query_id", "vec_id", "score"])

    found = both.mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))

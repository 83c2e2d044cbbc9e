"""SimHash near-duplicates: fingerprints, vantage-point trees over Hamming distance, connected components.

Two fingerprints that differ in at most ``bits`` of 64 agree up to ``bits // blocks`` bits on one of ``blocks`` equal
slices. So there is one vantage-point tree for each slice: its nodes measure the Hamming distance on that slice (a
pseudo-metric, so the triangle bound holds) and a ball of radius ``bits // blocks`` decides which side, or which
sides, a fingerprint visits. Where a slice no longer tells the fingerprints of a node apart, the node measures all 64
bits, with radius ``bits``. Each fingerprint goes to every shard its ball overlaps; within a shard the pairs are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut, table, written

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``width`` words, in arrays of bounded length; bytes.lower() lowers A-Z only."""
    words = text.lower().split()
    if not words:
        return
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 15):
        s, e = starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist()
        yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(s, e, strict=True)), np.uint64, len(s))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """Bit i is 1 if it is set in over half of the hashes. None: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0]) if n else 0


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The majority of the hashes of all shingles. No words, or null: 0."""
    return majority(shingle_hashes(text or b"", width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row, whatever other columns there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(x, width) for x in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    # ids travel as text, so that a null does not make the column floating
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


@dataclass
class Node:
    """An inner node has a vantage point and two sides; a leaf has a shard's number."""

    mask: np.uint64 = FULL
    radius: int = 0
    vantage: np.uint64 = np.uint64(0)
    limit: int = 0
    near: Node | None = None
    far: Node | None = None
    shard: int = -1


def grow(sample: np.ndarray, most: int, mask: np.uint64, radius: int, bits: int, rng: np.random.Generator, shards: list[int]) -> Node:
    """A tree whose leaves hold at most ``most`` of the sample where a split doesn't copy most of it to both sides."""
    best = None
    for m, r in ((mask, radius), (FULL, bits)) if len(sample) > most else ():
        for v in rng.choice(sample, min(5, len(sample)), replace=False):
            d = np.bitwise_count((sample ^ v) & m).astype(int)
            limit = int(np.median(d))
            limit -= limit == d.max()
            near, far = int((d - r <= limit).sum()), int((d + r > limit).sum())
            if limit >= d.min() and max(near, far) <= 0.8 * len(sample) and (best is None or max(near, far) < best[0]):
                best = max(near, far), m, r, v, limit, d
        if best is not None:
            break
    if best is None:
        shards.append(len(shards))
        return Node(shard=shards[-1])
    _, m, r, v, limit, d = best
    near, far = grow(sample[d - r <= limit], most, mask, radius, bits, rng, shards), grow(sample[d + r > limit], most, mask, radius, bits, rng, shards)
    return Node(m, r, v, limit, near, far)


def forest(sample: np.ndarray, most: int, bits: int = 3, blocks: int = 4, seed: int = 7) -> list[Node]:
    """One tree for each slice of the fingerprint."""
    rng, shards, width = np.random.default_rng(seed), [], 64 // blocks
    masks = [np.uint64(((1 << width) - 1) << (width * b)) for b in range(blocks)]
    return [grow(np.unique(sample), most, m, bits // blocks, bits, rng, shards) for m in masks]


def visited(trees: list[Node], x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in x that visit it)."""
    todo = [(t, np.arange(len(x))) for t in trees]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node.shard >= 0:
            yield node.shard, at
            continue
        d = np.bitwise_count((x[at] ^ node.vantage) & node.mask).astype(int)
        todo.append((node.near, at[d - node.radius <= node.limit]))
        todo.append((node.far, at[d + node.radius > node.limit]))


def local_links(x: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``bits``: members and their root, never all pairs.

    A breadth-first search that takes away what it reaches: a dense group costs as many rows as it has, not their square.
    """
    rest, child, root = np.unique(x), [], []
    while len(rest):
        first, rest = rest[0], rest[1:]
        front = [first]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                child.append(found)
                root.append(np.full(len(found), first))
                front.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(child), np.concatenate(root)) if child else (none, none)


def shard_links(x: np.ndarray, bits: int = 3, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """local_links() of a shard of any size: one that the sample's trees left large is split by trees of its own.

    Each pair within ``bits`` meets in one of their leaves, so components are the same; 8 bytes a row bound the memory.
    """
    x = np.unique(x)
    if len(x) <= most:
        return local_links(x, bits)
    parts = [local_links(x[at], bits) for _, at in visited(forest(x, most // 2, bits), x)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def links(fps: DataFrame, bits: int = 3, blocks: int = 4, shard_rows: int = 2048, sample_rows: int = 65536) -> DataFrame:
    """From distinct fingerprints (fp) to linking edges (a, b); their components equal those of all pairs within ``bits``.

    The trees come from a bounded sample (``sample_rows`` numbers); every fingerprint is placed and compared.
    """
    n = fps.count()
    take = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = forest(take, max(2, int(shard_rows * len(take) / max(1, n))), bits, blocks)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for shard, at in visited(trees, fp.view(np.uint64)):
                yield pd.DataFrame({"shard": np.full(len(at), shard), "fp": fp[at]})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        child, root = shard_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), bits)
        return pd.DataFrame({"a": child.view(np.int64), "b": root.view(np.int64)})

    # few bytes but much work a row: more tasks than the bytes ask for
    placed = fps.repartition(max(1, n // 16384)).mapInPandas(place, "shard int, fp long")
    return placed.groupBy("shard").applyInPandas(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null or empty text: fingerprint zero, linked like any other. Repeated rows and ties share a component. A null
    doc_id is never a component's name unless all of its ids are null. Texts of any length are hashed whole, in arrays of
    bounded length. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    marked = cut(fingerprints(docs, width))
    group = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(links(group.select("fp"), bits))
    named = group.join(comp, group.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Min-hashes of a text: this many bands of this many rows. A pair at similarity 0.8 shares a band with probability 0.99994.
BANDS, BAND_ROWS = 32, 6


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    found = list(shingle_hashes(text or b"", width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray, seed: int = 13) -> np.ndarray:
    """One number for each band: the hash of the least values of its hash functions over the shingles."""
    rng = np.random.default_rng(seed)
    times, plus = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    times |= np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, FULL)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * times + plus).min(axis=0), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, BAND_ROWS))), np.uint64, BANDS)


def band_cells(node: int, key: int, parts: int) -> Iterator[int]:
    """The groups of a band that a node goes to: of each two of its parts one, so that all pairs meet in at least one."""
    if parts == 1:
        yield 0
        return
    own = xxhash.xxh64_intdigest(node.to_bytes(8, "little", signed=True), key & 0xFFFFFFFF) % parts
    for other in range(parts):
        if other != own:
            yield min(own, other) * parts + max(own, other)


def similar_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """A spanning forest (member, root) of the pairs of sets whose Jaccard similarity is at least ``similar``, exactly.

    Like local_links(), a search that takes away what it reaches; common shingles are counted over lists of their owners.
    """
    size = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    begins, own = ends - np.bincount(code), np.split(code, np.cumsum(size)[:-1])
    alive, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        front = [first]
        while front and alive.any():
            x = front.pop()
            lists = [owner[a:b] for a, b in zip(begins[own[x]].tolist(), ends[own[x]].tolist(), strict=True) if b - a > 1]
            if not lists:
                continue
            common = np.bincount(np.concatenate(lists), minlength=len(sets))
            found = np.nonzero(alive & (common >= similar * (size + size[x] - common) - 1e-9))[0].tolist()
            alive[found] = False
            out += [(y, first) for y in found]
            front += found
    return out


def similar_texts(docs: DataFrame, width: int = 5, similar: float = 0.8, shard_rows: int = 4096, most: int = 1 << 21, bits: int = 3) -> DataFrame:
    """(row, doc_id, component) for each row of ``docs``; row: a hash of all its columns.

    Texts are linked if their sets of shingles of ``width`` words have a Jaccard similarity of at least ``similar``. The
    components of their fingerprints within ``bits``, by op6's trees, propose pairs; so do bands of min-hashes, as far
    fewer fingerprints than texts of that similarity lie so near. The sets themselves decide. A component counts as a band.
    Texts without words, or null, are one component.
    The texts of a band with over ``most`` shingles are dealt into parts, and each two parts meet in a group of their own:
    no task holds more than about ``most`` shingles or one text at a time, and no pair is lost.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            named, size, fp, keys = np.zeros(len(pdf), np.uint64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.uint64), []
            for i, text in enumerate(pdf["text"]):  # one text's shingles at a time
                x = shingle_set(text, width)
                named[i], size[i] = xxhash.xxh64_intdigest(x.tobytes()) if len(x) else 0, len(x)
                fp[i] = majority(x[k : k + (1 << 15)] for k in range(0, len(x), 1 << 15))
                keys.append(band_keys(x).view(np.int64) if len(x) else np.zeros(0, np.int64))
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "node": named.view(np.int64), "size": size, "fp": fp.view(np.int64), "keys": keys})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a compressed text is a quarter of its shingles' hashes
        pack = zstandard.ZstdCompressor(level=3).compress
        for pdf in batches:
            rows, held = [], 0
            for node, keys, parts, text in zip(pdf["node"], pdf["keys"], pdf["large"], pdf["text"], strict=True):
                packed, parts_of = pack(text), {x["key"]: x["parts"] for x in parts}
                for key in keys.tolist():
                    for cell in band_cells(int(node), key, parts_of.get(key, 1)):
                        rows.append((key, cell, node, packed))
                        held += len(packed)
                        if held > 1 << 24 or len(rows) == 8192:
                            yield pd.DataFrame(rows, columns=["key", "cell", "node", "packed"])
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=["key", "cell", "node", "packed"])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in pdf.groupby(["key", "cell"]):
            nodes = g["node"].tolist()
            found += [(nodes[a], nodes[b]) for a, b in similar_links([shingle_set(zstandard.decompress(x), width) for x in g["packed"]], similar)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = docs.select(row_hash(docs).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = written(rows.mapInPandas(sketch, "row string, doc_id string, node long, size long, fp long, keys array<long>"), "sketches")
    near = connected_components(links(marked.where("size > 0").select("fp").distinct(), bits)).select(F.col("node").alias("fp"), F.col("component").alias("of_fp"))
    # equal sets are one node; of each, one row gives the text
    nodes = marked.where("size > 0").groupBy("node").agg(F.min_by(F.struct("row", "size", "fp", "keys"), "row").alias("n")).select("node", "n.*").join(near, "fp", "left")
    by_fp = F.xxhash64(F.lit("fingerprint"), F.coalesce("of_fp", "fp"))
    nodes = nodes.select("node", "row", "size", F.explode(F.array_append("keys", by_fp)).alias("key"))
    # two parts meet at a time, so a part has half of the bound
    parts = F.when(F.col("size") <= most, 1).otherwise(F.least("n", F.ceil(F.col("size") * 2 / most))).cast("int")
    bands = cut(nodes.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1").withColumn("parts", parts))
    large = F.collect_list(F.when(F.col("parts") > 1, F.struct("key", "parts"))).alias("large")
    need = nodes.drop("size").join(bands.select("key", "parts"), "key").groupBy("row").agg(F.first("node").alias("node"), F.collect_list("key").alias("keys"), large)
    texts = rows.select("row", "text").join(written(need, "proposed"), "row").dropDuplicates(["row"]).select("node", "keys", "large", "text")
    times = F.greatest(F.lit(1), F.col("parts") - 1)
    whole = bands.agg(F.sum(times * F.col("n")).alias("n"), F.sum(times * F.col("size")).alias("size")).first()
    shards = 1 + max((whole["n"] or 0) // shard_rows, (whole["size"] or 0) // most)
    placed = texts.mapInPandas(place, "key long, cell long, node long, packed binary")
    edges = placed.groupBy(F.pmod(F.xxhash64("key", "cell"), F.lit(shards)).alias("shard")).applyInPandas(pairs, "a long, b long").distinct()
    comp = connected_components(edges).withColumnRenamed("component", "of")
    found = marked.select("row", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "node")
    return found.join(comp, "node", "left").select("row", "doc_id", F.coalesce("of", "node").alias("component"))


def row_hash(docs: DataFrame) -> Column:
    """128 bits of a row's columns, nulls told apart from other values."""
    values = [F.to_json(F.struct(c)) if f.dataType.simpleString().find("map<") >= 0 else F.col(c) for c, f in ((f"`{f.name}`", f) for f in docs.schema.fields)]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in docs.columns])
    return F.concat_ws("/", F.xxhash64(F.lit("one"), nulls, *values).cast("string"), F.xxhash64(F.lit("other"), nulls, *values).cast("string"))


def keep_one(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component of similar_texts() the row with the least id, nulls last.

    Rows that share an id are told apart by a hash of all columns, the least stays; of equal rows one stays. Null and
    empty texts are one component. Texts of any length are read whole. Columns may have any names. No rows: none.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    first = similar_texts(docs, width, similar).groupBy("component").agg(best).select(F.col("best.row").alias("near_row"))
    # the columns to keep travel in a struct, so that none of them meets a name used here
    rows = docs.select(row_hash(docs).alias("near_row"), F.struct(*docs.columns).alias("near_kept"))
    kept = rows.join(first, "near_row", "left_semi").dropDuplicates(["near_row"])
    return kept.select(*[F.col("near_kept")[c].alias(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

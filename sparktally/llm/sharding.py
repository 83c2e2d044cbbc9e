"""Minimax contiguous sharding: the smallest capacity with which ordered atomic groups fit the shards, then cut there.

Groups are documents of equal text, in the order of the text's hash; buckets of leading hash digits cut that order into
a bounded number of stretches. The driver holds the sums by bucket; a bucket into which a cut falls is replaced by the
sums of its own buckets of more digits, or by its groups once they are few, so every answer has at most 4,096 rows and
their number follows the shards and the digits of the hash, not the data. Row numbers come from sums over cells (a
group's rows by a hash of the id), so a group of a third of all rows is never in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BUCKET_DIGITS, SALTS = 3, 64

#: A stretch of the line: its name (leading digits, or a whole key), bytes, and number of groups.
Stretch = tuple[str, int, int]


class Line:
    """The ordered groups as a line of bytes: sums by bucket here, finer ones when asked for."""

    def __init__(self, stretches: list[Stretch], read: Callable[[list[Stretch]], dict[str, list[Stretch]]]) -> None:
        self.stretches, self.read = stretches, read
        self.measure()

    def measure(self) -> None:
        self.ends = list(accumulate(size for _, size, _ in self.stretches))
        self.starts = [0, *self.ends[:-1]]
        self.total = self.ends[-1] if self.ends else 0

    def furthest(self, limit: int) -> tuple[int, int, str | None]:
        """The last group boundary up to ``limit``, as bounds from below and above; then the bucket to read, if they differ."""
        if limit >= self.total:
            return self.total, self.total, None
        b = bisect_right(self.ends, limit)
        if limit == self.starts[b] or self.stretches[b][2] == 1:
            return self.starts[b], self.starts[b], None
        return self.starts[b], limit, self.stretches[b][0]

    def learn(self, names: set[str]) -> None:
        """Puts finer stretches in the place of these."""
        found = self.read([x for x in self.stretches if x[0] in names])
        self.stretches = [y for x in self.stretches for y in (found[x[0]] if x[0] in names else (x,))]
        self.measure()

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int], set[str]]:
        """The greedy cuts as bounds from below and above, and the buckets that would close the gap."""
        low, high, unknown = [0], [0], set()
        for _ in range(shards):
            a, _, x = self.furthest(low[-1] + capacity)
            _, b, y = self.furthest(high[-1] + capacity)
            low.append(a)
            high.append(b)
            unknown |= {z for z in (x, y) if z is not None}
        return low, high, unknown

    def fits(self, capacity: int, shards: int) -> bool:
        while True:
            low, high, unknown = self.cuts(capacity, shards)
            if low[-1] >= self.total or high[-1] < self.total:
                return low[-1] >= self.total
            self.learn(unknown)

    def smallest(self, shards: int, largest: int) -> tuple[int, list[int]]:
        """The smallest capacity that fits, and where its shards begin."""
        few = max(largest, -(-self.total // shards))
        many = few + largest
        while few < many:
            middle = (few + many) // 2
            few, many = (few, middle) if self.fits(middle, shards) else (middle + 1, many)
        while True:
            low, high, unknown = self.cuts(few, shards)
            if low == high:
                return few, self.even(low, few, shards)
            self.learn(unknown)

    def around(self, x: int) -> tuple[int, int]:
        """The last group boundary up to ``x`` and the first from ``x`` on."""
        x = min(max(x, 0), self.total)
        while True:
            low, high, unknown = self.furthest(x)
            if unknown is None:
                return low, x if low == x else self.ends[bisect_right(self.starts, low) - 1]
            self.learn({unknown})

    def even(self, latest: list[int], capacity: int, shards: int) -> list[int]:
        """Where shards begin: each cut as near to an even share as the capacity allows on both of its sides.

        latest: the greedy cuts from the left. Those from the right are the earliest; between them any cut leaves room.
        """
        ideal = [self.total * i // shards for i in range(shards + 1)]
        while unknown := {z for x in ideal[1:-1] if (z := self.furthest(x)[2]) is not None}:
            self.learn(unknown)
        earliest = [self.total]
        for _ in range(shards - 1):
            earliest.append(self.around(earliest[-1] - capacity)[1])
        begins = [0]
        for i, least in zip(range(1, shards), earliest[:0:-1], strict=True):
            most = min(latest[i], self.around(begins[-1] + capacity)[0])
            below, above = self.around(ideal[i])
            near = below if ideal[i] - below <= above - ideal[i] else above
            begins.append(min(max(near, least, begins[-1]), most))
        return begins


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with size, text_crc32 and the columns that place a row: shard_key, shard_bucket, shard_salt.

    Null text: 8 bytes, the checksum of the empty text, and a group of its own.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(text))
    docs = docs.select("*", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), key.alias("shard_key"))
    return docs.withColumns({"shard_bucket": F.substring("shard_key", 1, BUCKET_DIGITS), "shard_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})


def shard(docs: DataFrame, shards: int = 24, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, text_crc32, law, shard, slot and grown_shard.

    Law ``bytes``: the largest shard is as small as any cut of the ordered groups allows. Equal texts, repeated rows
    among them, share a shard; slots count from 0 in each shard. A group above an even share has its shard to itself
    at most, and later shards may then be empty. Fewer groups than shards: shards at the end stay empty. No rows: none.
    Texts of any length are measured whole. A column of ``docs`` named like one of the added ones gives way to it.
    """
    keep = [c for c in keep or docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    # the columns to keep travel in a struct, so that none of them meets a name used here
    rows = measured(docs.select(F.struct(*keep).alias("kept"), "doc_id", "text")).drop("text")
    cells = cut(rows.groupBy("shard_bucket", "shard_key", "shard_salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    groups = cut(cells.groupBy("shard_bucket", "shard_key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    # at most 16 ** BUCKET_DIGITS + 1 rows
    sums = sorted(groups.groupBy("shard_bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("most"), F.count("*").alias("groups")).collect())

    def read(stretches: list[Stretch]) -> dict[str, list[Stretch]]:
        found: dict[str, list[Stretch]] = {name: [] for name, _, _ in stretches}
        for digits in {len(name) for name in found}:
            own = [x for x in stretches if len(x[0]) == digits]
            for few in (True, False):
                names = [name for name, _, n in own if (n <= 16**BUCKET_DIGITS) == few]
                if names:
                    finer = F.col("shard_key") if few else F.substring("shard_key", 1, digits + BUCKET_DIGITS)
                    at = groups.where(F.substring("shard_key", 1, BUCKET_DIGITS).isin([x[:BUCKET_DIGITS] for x in names]))
                    at = at.withColumn("of", F.substring("shard_key", 1, digits)).where(F.col("of").isin(names))
                    for r in sorted(at.groupBy("of", finer.alias("name")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups")).collect()):
                        found[r.of].append((r.name, r.bytes, r.groups))
        return found

    line = Line([(r.shard_bucket, r.bytes, r.groups) for r in sums], read)
    starts_by_bucket = list(line.starts)
    _, begins = line.smallest(shards, max((r.most for r in sums), default=0)) if sums else (0, [0])
    before = list(accumulate((r.n for r in sums), initial=0))
    offsets = docs.sparkSession.createDataFrame([(r.shard_bucket, s, b) for r, s, b in zip(sums, starts_by_bucket, before, strict=False)], "shard_bucket string, bytes_before long, rows_before long")

    in_bucket = Window.partitionBy("shard_bucket")
    ends = F.sum("bytes").over(in_bucket.orderBy("shard_key").rangeBetween(Window.unboundedPreceding, 0))
    own = F.sum("bytes").over(Window.partitionBy("shard_bucket", "shard_key"))
    rows_before = F.coalesce(F.sum("n").over(in_bucket.orderBy("shard_key", "shard_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last shard that begins at or before the group; shards left empty begin where the next one does
    starts = F.array(*[F.lit(x).cast("long") for x in begins])
    at: Column = F.size(F.filter(starts, lambda x: x <= F.col("group_from"))) - 1
    placed = (
        cells.join(F.broadcast(offsets), "shard_bucket")
        .withColumns({"group_from": F.col("bytes_before") + ends - own, "cell_row": F.col("rows_before") + rows_before})
        .withColumn("shard", at.cast("int"))
        .select("shard_key", "shard_salt", "shard", "cell_row")
    )
    first = placed.groupBy("shard").agg(F.min("cell_row").alias("first_row"))  # one row for each shard
    placed = placed.join(F.broadcast(first), "shard")
    turn = F.row_number().over(Window.partitionBy("shard_key", "shard_salt").orderBy("doc_id", "size")) - 1
    return rows.join(placed, ["shard_key", "shard_salt"]).select(
        "kept.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("cell_row") - F.col("first_row") + turn).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), keep=["doc_id"])

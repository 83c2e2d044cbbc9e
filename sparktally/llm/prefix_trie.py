"""The prefix trie of conversations: which turns conversations share from their start on.

A conversation is a row of turn-id columns, as many as a block has; a long one goes on in further rows, keyed by the node
where the block before ends. One ROLLUP over the columns aggregates the conversations of all prefixes together, and
grouping_id() says how long each prefix is. Two such passes suffice for sums over subtrees, however deep the trie:
the first gives each node its owner (its smallest member), from which follows where each conversation leaves the nodes of
smaller ones; the second sums, by node, what its members bring along. No node is asked for its subtree.

A node's key is 128 bits: the exclusive or, over its blocks, of two hashes of the block's number and turn ids. A turn's id is
128 bits of its SHA-256, and its code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, written

WIDTH = 8
IDS = [f"t{i}" for i in range(1, WIDTH + 1)]
#: The bound of the query's shared openings: h is below it.
HEADS = 6
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over role and text, then the text's code points in four bytes."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0")))


def chars(turn: Column) -> Column:
    return F.conv(F.substring(F.hex(turn), 33, 8), 16, 10).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn): the turn ids of each conversation by position, from 1. Rows without a conv_id belong to none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("nth"), turn_id(role, text).alias("turn"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("nth"), "turn")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "turn")


def with_openings(turns: DataFrame, every: int = 100, heads: int = HEADS) -> DataFrame:
    """(conv, pos, turn) after each conversation's first h turns gave way to those of conversation c - c % every.

    h: crc32 of the decimal id, modulo ``heads``. Each conversation also has a row with position 0 and no turn, so that
    those left without turns stay. A conversation gives its opening to at most ``every`` others.
    """
    own = turns.where("pos = 1").select("conv", (F.crc32(F.col("conv").cast("string")) % heads).cast("int").alias("h"))
    opening = turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("head"))
    taken = F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h"))
    own = own.withColumn("base", F.col("conv") - F.col("conv") % every).join(opening, "base", "left").select("conv", "h", taken.alias("head"))
    first = own.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.turn")
    rest = turns.join(own.select("conv", "h", F.size("head").alias("k")), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn")
    none = own.select("conv", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"))
    return first.unionByName(rest).unionByName(none)


def hashed(block: Column, ids: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(salt), block, *ids) for salt in ("one", "other")]


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row for each conversation and block: its turn ids t1..., the node before it (k1, k2) and that node's code points.

    block 0: k1 = k2 = 0. length, chars: those of the whole conversation.
    """
    by = turns.withColumn("block", F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / WIDTH)).otherwise(0))
    own = F.sort_array(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "turn"))))
    rows = by.groupBy("conv", "block").agg(own.alias("own"))
    rows = rows.select("conv", "block", F.size("own").alias("n"), *[F.get("own", F.lit(i))["turn"].alias(c) for i, c in enumerate(IDS)])
    one, other = hashed(F.col("block"), [F.col(c) for c in IDS])
    size = sum((F.coalesce(chars(F.col(c)), F.lit(0)) for c in IDS), F.lit(0))
    rows = rows.select("*", one.alias("b1"), other.alias("b2"), size.alias("size"))
    whole = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select("conv", "block", "n", *IDS, zero(F.bit_xor("b1").over(before)).alias("k1"), zero(F.bit_xor("b2").over(before)).alias("k2"), zero(F.sum("size").over(before)).alias("before"), F.sum("n").over(whole).alias("length"))


def key_at(depth: Column) -> list[Column]:
    """The key of the node of a block's first ``depth`` turns."""
    ids = [F.when(depth > i, F.col(c)) for i, c in enumerate(IDS)]
    return [F.col(k).bitwiseXOR(h) for k, h in zip(("k1", "k2"), hashed(F.col("block"), ids), strict=True)]


def rolled_up(rows: DataFrame, *sums: str) -> DataFrame:
    """A row for each node: its key (n1, n2) and its parent's (p1, p2), depth, owner, members, and ``sums``.

    before, last: the code points before its last text, and of it. leaf: whether all members end here.
    """
    ids = ", ".join(IDS)
    nodes = rows.sparkSession.sql(
        f"""SELECT block, k1, k2, before, {ids}, {WIDTH} - bit_count(grouping_id()) AS at, count(*) AS n_convs, min(conv) AS owner, max(length) AS longest{''.join(f', {s}' for s in sums)}
        FROM {{rows}} GROUP BY block, k1, k2, before, ROLLUP ({ids})""",
        rows=rows,
    )
    last = F.get(F.array(*IDS), F.col("at") - 1)
    # padding makes groups of no node, and a later block's empty prefix is the node before it
    nodes = nodes.where(F.when(F.col("at") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    (n1, n2), (p1, p2) = key_at(F.col("at")), key_at(F.col("at") - 1)
    start = (F.col("at") == 1) & (F.col("block") > 0)
    nodes = nodes.withColumns({"n1": n1, "n2": n2, "p1": F.when(start, F.col("k1")).otherwise(p1), "p2": F.when(start, F.col("k2")).otherwise(p2)})
    size = [F.coalesce(chars(F.col(c)), F.lit(0)) for c in IDS]
    earlier = sum((F.when(F.col("at") > i + 1, s).otherwise(0) for i, s in enumerate(size)), F.col("before"))
    depth = F.col("block") * WIDTH + F.col("at")
    return nodes.withColumns({"depth": depth, "before": earlier, "last": F.coalesce(chars(last), F.lit(0)), "leaf": F.col("longest") == depth}).drop("block", "k1", "k2", "at", "longest", *IDS)


def digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): the hash of the members that end at each node, in order.

    Members are joined into compressed pieces where they lie after a range partition, so a node where a third of all
    conversations end is many tasks' work; the pieces then pass one after the other through the node's hash.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2, conv = (batch[c].to_pylist() for c in ("n1", "n2", "conv"))
            starts = [i for i in range(len(conv)) if not i or (n1[i], n2[i]) != (n1[i - 1], n2[i - 1])]
            out = [(n1[a], n2[a], conv[a], ",".join(map(str, conv[a:b]))) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("n1", "n2", "first", "ids"), x, strict=True)) for x in out], schema=pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        schema = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for n1, n2, ids in zip(*(batch[c].to_pylist() for c in ("n1", "n2", "ids")), strict=True):
                if at == (n1, n2):
                    digest.update(f",{ids}".encode())
                    continue
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (n1, n2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
            out = []
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, digest.hexdigest()), strict=True))], schema=schema)

    keys = ["n1", "n2"]
    parts = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(pieces, "n1 long, n2 long, first long, ids string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(joined, "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv, pos, turn), which has a row with position 0 for each conversation.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as the query returns them.
    """
    rows = written(blocks_of(turns), "blocks")
    nodes = rolled_up(rows)
    # a conversation owns the end of its path, from depth ``first`` on; ``shared``: the code points it shares with smaller ones
    own = F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2"), F.min("before").alias("shared")
    nodes = written(nodes.select("n1", "n2", "p1", "p2", "depth", "owner", "before", "leaf"), "owners")
    owners = cut(nodes.groupBy("owner").agg(F.min("depth").alias("first"), *own, F.max(F.col("leaf").cast("long")).alias("leaves")))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("owner").alias("parent"))
    leaving = owners.where("first > 0")
    parent = leaving.join(parents, ["p1", "p2"]).select(F.col("owner").alias("conv"), "parent")
    born = leaving.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("born"))
    # one that owns nothing ends where a smaller one does: all of it is shared
    total = F.col("before") + sum((F.coalesce(chars(F.col(c)), F.lit(0)) for c in IDS), F.lit(0))
    brought = rows.join(owners.select(F.col("owner").alias("conv"), "first", "shared", "leaves"), "conv", "left").join(parent, "conv", "left")
    whole = F.max(total).over(Window.partitionBy("conv"))
    brought = brought.withColumns({"shared": F.coalesce("shared", whole), "leaves": F.coalesce("leaves", F.lit(0))})
    sums = ["sum(shared) AS shared", "sum(leaves) AS n_leaves", "min_by(shared, conv) AS owner_shared", "min_by(first, conv) AS first", "min_by(parent, conv) AS parent", "min_by(length, conv) AS owner_length"]
    # what a member shares beyond the node's own start is saved; its owner leaves no one here
    saved = F.col("shared") - F.col("owner_shared") - (F.col("n_convs") - 1) * F.col("before")
    ends = rows.where(F.col("block") == F.floor((F.greatest("length", F.lit(1)) - 1) / WIDTH))
    n1, n2 = key_at(F.col("n"))
    out = rolled_up(brought, *sums).join(born, ["n1", "n2"], "left").join(digests(ends.select("conv", n1.alias("n1"), n2.alias("n2"))), ["n1", "n2"], "left")
    return out.select(
        F.col("owner").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("born", F.lit(0)) + (F.col("owner_length") > F.col("depth")).cast("long")).alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with shared openings.

    Null roles and texts are empty; rows without a conv_id belong to no conversation; turns of one number go by their ids,
    repeated rows are turns like others. A conversation's turn ids (20 bytes each, no texts) are ordered in one task, on disk
    if need be. Other columns, whatever their names, are ignored. No conversations: no rows, not even the root.
    """
    return trie(with_openings(turns_of(table(spark, sf_dir, "conversations"))))


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END))"
#: The same rows in DuckDB: each prefix as a list of turns, each node joined to its ancestors through the slices of its list.
SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns, xor({_CRC}, 4294967295) % {HEADS} AS h FROM o GROUP BY conv_id),
c AS (SELECT l.conv_id, list_concat(coalesce(b.turns, [])[1:l.h], l.turns[l.h + 1:]) AS turns FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 100),
p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM c),
n AS (SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends FROM p GROUP BY ALL),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.path[depth].text) ELSE 0 END AS saved FROM n LEFT JOIN k ON n.path = k.path),
u AS (SELECT path, unnest(range(0, depth + 1)) AS above, n_children, saved FROM f),
s AS (SELECT path[1:above] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON f.path = s.path LEFT JOIN n q ON f.depth > 0 AND q.path = f.path[1:f.depth - 1]
"""

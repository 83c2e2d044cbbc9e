"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents lie in a permuted order (by hash) on a line of words, cut into blocks by the leading digits of
the hash. A source's target becomes a quota of blocks: whole epochs of all of them, then the first ones of the line, the
last in part. A splitting tree deals the quotas to output shards: at each node the lots of all sources are halved in a
hashed order, so that what a source gives to the left is a multivariate hypergeometric draw, and the leaves' counts are
exact quotas by source and shard. Each shard then draws as many blocks of a permuted list, no block twice; what the mix
takes of a document is the sum over the draws of its block. Within a shard documents are ordered by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Leading hex digits of the permuting hash that name a block: 16 ** 2 blocks in each source. Where a block is drawn in
#: part, so many more digits at a time narrow down where it is cut.
BLOCK_DIGITS, STEP_DIGITS = 2, 2


def order_key(doc_id: Column) -> Column:
    """The permuted place of a document in its source: the same in every run."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share ``total_share`` of all words; a target stops
    at ``most`` times its source and the excess is reshared by weight. The fixed point of that: with sources ordered by
    limit over weight, a source stops at its limit as long as an equal share of the rest would exceed it.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    named = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    limited = named.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    ordered = limited.withColumn("ratio", F.col("most") / F.col("weight"))
    left = (
        ordered.withColumn("words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("stopped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    share = (F.col("words") * F.lit(float(total_share)) - F.col("stopped") * F.lit(float(most))) / (F.col("all_weight") - F.col("stopped_weight"))
    rated = left.withColumn("share", share).withColumn("open", F.when(F.col("share") < F.col("ratio"), F.col("share")))
    # the first share that is not stopped holds for all after it
    level = F.first("open", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rated.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def sized(docs: DataFrame) -> DataFrame:
    """The documents with their words counted, their permuted place and their block."""
    key = order_key(F.col("doc_id"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"mix_size": size, "mix_key": key, "mix_block": F.substring(key, 1, BLOCK_DIGITS)})


def plan(rows: DataFrame, most_rows: int = 200_000, part_rows: int = 10_000) -> DataFrame:
    """From sized rows to their blocks: source, mix_block, block_size, block_from (its first word on the source's line),
    source_size, target, epochs (how often the whole source is taken), rest (the words of the epoch after those), and
    for the block in which those end cut_prefix (of the keys of at most ``part_rows`` rows, or of one key) and cut_from.

    At most 256 rows for a source, kept in the shared folder; marked for broadcast if there are at most ``most_rows``.
    """
    blocks = cut(rows.groupBy("source", "mix_block").agg(F.sum("mix_size").alias("block_size"), F.count("*").alias("block_rows")))
    line = Window.partitionBy("source").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("block_from", F.coalesce(F.sum("block_size").over(line), F.lit(0)))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"))).withColumnRenamed("source", "of")
    words = F.round("target").cast("long")
    found = (
        placed.join(targets, placed.source.eqNullSafe(targets.of))
        .drop("of")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div source_size")).otherwise(0))
        .withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    )
    found = cut(found)
    small = blocks.count() <= most_rows
    ends = cut_places(rows, found, part_rows, small)
    found = found.join(ends, found.source.eqNullSafe(ends.of) & (found.mix_block == ends.of_block), "left").drop("of", "of_block", "block_rows")
    return F.broadcast(found) if small else found


def cut_places(rows: DataFrame, blocks: DataFrame, part_rows: int, small: bool) -> DataFrame:
    """(of, of_block, cut_prefix, cut_from): for each source's partly drawn block the leading digits of the keys among which
    the cut lies, and how many words stand before them. Narrowed down by sums, never by ordering a block's rows in one task.
    """
    inside = (F.col("rest") > F.col("block_from")) & (F.col("rest") < F.col("block_from") + F.col("block_size"))
    ends = blocks.where(inside).select(F.col("source").alias("of"), F.col("mix_block").alias("of_block"), F.col("mix_block").alias("cut_prefix"), F.col("block_from").alias("cut_from"), "rest", F.col("block_rows").alias("n"))
    hint = F.broadcast if small else lambda df: df
    most, digits, part = ends.agg(F.max("n")).first()[0] or 0, BLOCK_DIGITS, None
    while most > part_rows and digits < 32:
        digits += STEP_DIGITS
        if part is None:
            own = hint(ends.select("of", "of_block"))
            part = cut(rows.join(own, rows.source.eqNullSafe(own.of) & (rows.mix_block == own.of_block)).select("source", "mix_key", "mix_size"))
        now = hint(ends.drop("n"))
        inner = part.join(now, part.source.eqNullSafe(now.of) & F.col("mix_key").startswith(F.col("cut_prefix")))
        sums = inner.groupBy("of", "of_block", "cut_from", "rest", F.substring("mix_key", 1, digits).alias("prefix")).agg(F.sum("mix_size").alias("words"), F.count("*").alias("n"))
        upto = F.col("cut_from") + F.sum("words").over(Window.partitionBy("of").orderBy("prefix"))
        sums = sums.withColumn("upto", upto).where((F.col("rest") > F.col("upto") - F.col("words")) & (F.col("rest") <= F.col("upto")))
        ends = cut(sums.select("of", "of_block", F.col("prefix").alias("cut_prefix"), (F.col("upto") - F.col("words")).alias("cut_from"), "rest", "n"))
        most = ends.agg(F.max("n")).first()[0] or 0
    return ends.drop("rest", "n")


def unit_shards(blocks: DataFrame, depth: int = 5, seed: int = 11) -> DataFrame:
    """(source, mix_block, epoch, mix_shard): each draw of a block, whole or in part, and its shard of 2 ** depth.

    quotas() says how many draws each shard has of each source; a source's draws in a permuted order fill them in turn.
    """
    units = (
        blocks.select("source", "mix_block", "block_from", "block_size", "source_size", F.round("target").cast("long").alias("goal"), F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
        .where("block_size > 0")
        .where(F.col("block_from") + F.col("epoch") * F.col("source_size") < F.col("goal"))
    )
    order = F.md5(F.concat_ws("/", F.lit(seed), F.lit("draw"), F.coalesce("source", F.lit("")), "mix_block", "epoch"))
    units = units.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(order, "mix_block", "epoch")))
    share = quotas(units.groupBy("source").agg(F.count("*").alias("quota")), depth, seed)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("mix_shard"))
    share = share.select(F.col("source").alias("of"), "mix_shard", upto.alias("upto"), (upto - F.col("quota")).alias("before"))
    drawn = units.join(share, units.source.eqNullSafe(share.of) & (F.col("k") > F.col("before")) & (F.col("k") <= F.col("upto")))
    return drawn.select("source", "mix_block", "epoch", "mix_shard")


def quotas(whole: DataFrame, depth: int = 5, seed: int = 11) -> DataFrame:
    """From (source, quota) to (source, mix_shard, quota): the splitting tree.

    Every node halves its lots, one for each block of its quotas, in a hashed order; a shard's quotas are the lots that
    reach its leaf. Those of a source add up to its quota, those of a shard to an equal share within one for each level.
    """
    lots = whole.select("source", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("lot"), F.lit(0).alias("mix_shard"))
    for level in range(depth):
        node = Window.partitionBy("mix_shard")
        order = F.md5(F.concat_ws("/", F.lit(seed), F.lit(level), F.coalesce("source", F.lit("")), "lot"))
        left = F.row_number().over(node.orderBy(order, "source", "lot")) * 2 <= F.count("*").over(node)
        lots = lots.withColumn("mix_shard", F.col("mix_shard") * 2 + F.when(left, 0).otherwise(1))
    return lots.groupBy("source", "mix_shard").agg(F.count("*").alias("quota"))


def taken_words(rows: DataFrame, blocks: DataFrame, depth: int = 5, most_rows: int = 200_000) -> DataFrame:
    """``rows`` of sized() with source_size, target, taken and mix_draws: (epoch, mix_shard, words) of each draw of a part of it.

    taken sums the words of the draws of the document's block: its size from a whole draw, what stands before the cut
    from a partial one. The sum over a source is its target, rounded; a document gives at most twice its words, one
    without words none. Only the few rows among which a block is cut are put in order. A column of ``rows`` named like
    one of the added ones gives way to it.
    """
    draws = unit_shards(blocks, depth).groupBy("source", "mix_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "mix_shard"))).alias("draws"))
    draws = draws.select(F.col("source").alias("of"), F.col("mix_block").alias("of_block"), "draws")
    about = blocks.join(draws, blocks.source.eqNullSafe(draws.of) & (blocks.mix_block == draws.of_block), "left").drop("of", "of_block")
    about = about.select(F.struct("block_from", "block_size", "source_size", "target", "epochs", "rest", "cut_prefix", "cut_from", "draws").alias("mix_about"), F.col("source").alias("mix_of"), F.col("mix_block").alias("mix_at"))
    about = cut(about)
    about = F.broadcast(about) if about.count() <= most_rows else about
    rows = rows.drop("source_size", "target", "taken", "mix_draws")
    joined = rows.join(about, rows.source.eqNullSafe(about.mix_of) & (rows.mix_block == about.mix_at))
    a = lambda c: F.col("mix_about")[c]
    at_cut = F.coalesce(F.col("mix_key").startswith(a("cut_prefix")), F.lit(False))
    before = (a("rest") >= a("block_from") + a("block_size")) | ((a("rest") > a("block_from")) & (F.col("mix_key") < a("cut_prefix")))
    whole = joined.where(~at_cut).withColumn("mix_part", F.when(before, F.col("mix_size")).otherwise(F.lit(0).cast("long")))
    tied = Window.partitionBy("source").orderBy("mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    start = a("cut_from") + F.coalesce(F.sum("mix_size").over(tied), F.lit(0))
    part = joined.where(at_cut).withColumn("mix_part", F.greatest(F.lit(0), F.least(F.col("mix_size"), a("rest") - start)).cast("long"))
    given = F.transform(a("draws"), lambda d: F.struct(d["epoch"].alias("epoch"), d["mix_shard"].alias("mix_shard"), F.when(d["epoch"] < a("epochs"), F.col("mix_size")).otherwise(F.col("mix_part")).alias("words")))
    given = F.filter(given, lambda d: d["words"] > 0)
    none = F.array().cast("array<struct<epoch:int,mix_shard:int,words:bigint>>")
    out = whole.unionByName(part).withColumn("mix_draws", F.coalesce(given, none))
    taken = F.aggregate("mix_draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return out.withColumns({"source_size": a("source_size"), "target": a("target"), "taken": taken}).drop("mix_about", "mix_of", "mix_at", "mix_part")


def mix(docs: DataFrame, depth: int = 5) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` for each copy taken, with mix_shard and mix_place.

    A copy of which only a part is taken keeps the first words of its text. mix_place orders a shard's documents at random.
    Null source: a source of its own. Null text: nothing to take. Repeated rows count as rows. Texts of any length are
    counted whole. No rows: none. Columns of ``docs`` may have any names but mix_shard and mix_place, which give way.
    """
    kept = [c for c in docs.columns if c not in ("mix_shard", "mix_place")]
    # the columns to keep travel in a struct, so that none of them meets a name used here
    rows = sized(docs.select(F.struct(*kept).alias("mix_row"), "doc_id", "source", "text"))
    copies = taken_words(rows, plan(rows), depth).withColumn("draw", F.explode("mix_draws"))
    words = F.col("draw.words")
    # the run of the first `words` words with what stands before and between them
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.greatest(words, F.lit(1)).cast("int")), "")
    cut_off = words < F.col("mix_size")
    text = F.when(cut_off, part).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(cut_off, F.length(text)).otherwise(F.col("mix_row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in kept else {})
    columns = [changed[c].alias(c) if c in changed else F.col("mix_row")[c].alias(c) for c in kept]
    return copies.select(*columns, "draw.mix_shard", F.xxhash64(F.lit("place"), "mix_key", "draw.epoch").alias("mix_place"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its size, its source's size and target, and the words that the mix takes of it.

    Also the shards its copies go to, by epoch; -1: that epoch doesn't take it.
    """
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    taken = taken_words(rows, plan(rows))
    shard = lambda e: F.coalesce(F.get(F.filter("mix_draws", lambda d: d["epoch"] == e), F.lit(0))["mix_shard"], F.lit(-1))
    return taken.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken", shard(0).alias("first_shard"), shard(1).alias("second_shard"))


#: The same rows in DuckDB: the line of words in one window for each source, the tree level by level.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS most FROM s),
x AS (SELECT *, most / weight AS ratio FROM w),
y AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS words, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
  CAST(coalesce(sum(source_size) OVER p, 0) AS DOUBLE) AS stopped, CAST(coalesce(sum(weight) OVER p, 0) AS BIGINT) AS stopped_weight
  FROM x WINDOW p AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (words * 1.5::DOUBLE - stopped * 2.0::DOUBLE) / CAST(all_weight - stopped_weight AS DOUBLE) AS share FROM y),
v AS (SELECT *, (SELECT share FROM z WHERE share < ratio ORDER BY ratio, source IS NULL, source LIMIT 1) AS level FROM z),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN most ELSE level * weight END AS target FROM v),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
a AS (SELECT d.*, q.source_size, q.target, q.epochs, q.goal - q.epochs * q.source_size AS rest, substr(k, 1, 2) AS block,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
m AS (SELECT *, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM a),
b AS (SELECT source, block, min(source_size) AS source_size, min(target) AS target, min(start) AS block_from, sum(size) AS block_size FROM a GROUP BY source, block),
u AS (SELECT source, block, epoch, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('/', '11', 'draw', coalesce(source, ''), block, CAST(epoch AS VARCHAR))), block, epoch) AS k
  FROM b, (VALUES (0), (1)) e(epoch) WHERE block_size > 0 AND block_from + epoch * source_size < CAST(round(target) AS BIGINT)),
u0 AS (SELECT source, k AS lot, 0 AS shard FROM u),
""" + "\n".join(
    f"""h{i} AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('/', '11', '{i}', coalesce(source, ''), CAST(lot AS VARCHAR))), source, lot) AS place, count(*) OVER (PARTITION BY shard) AS n FROM u{i}),
u{i + 1} AS (SELECT source, lot, shard * 2 + CASE WHEN place * 2 <= n THEN 0 ELSE 1 END AS shard FROM h{i}),"""
    for i in range(5)
) + """
c AS (SELECT source, shard, count(*) AS quota FROM u5 GROUP BY source, shard),
g AS (SELECT source, shard, sum(quota) OVER (PARTITION BY source ORDER BY shard) AS upto, quota FROM c),
r AS (SELECT u.source, u.block, u.epoch, g.shard FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source AND u.k > g.upto - g.quota AND u.k <= g.upto),
f AS (SELECT source, block, max(shard) FILTER (epoch = 0) AS first, max(shard) FILTER (epoch = 1) AS second FROM r GROUP BY source, block)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN first ELSE -1 END AS first_shard, CASE WHEN taken > size THEN second ELSE -1 END AS second_shard
FROM m LEFT JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.block = f.block
"""

"""Joins, set operations, grouping and row choice on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import by_priority, keep_first, upsert
from ..operators.graph import connected_components
from ..session import table
from .catalog import query

LONG = "bigint"


@query(
    """SELECT user_id, event_type, event_id, value, src FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY level, ts DESC, event_id DESC) AS nth FROM (
      SELECT *, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 IN (1, 2) THEN 1 ELSE 2 END AS level,
        CASE WHEN event_id % 5 = 0 THEN 'recovery' WHEN event_id % 5 IN (1, 2) THEN 'rerun' ELSE 'full' END AS src FROM events)) WHERE nth = 1"""
)
def q_priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Three shards of a run, merged by trust: the last row of a key within a shard, the most trusted shard across them."""
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    part = F.col("event_id") % 5
    levels = [events.where(part == 0).withColumn("src", F.lit("recovery")), events.where(part.isin(1, 2)).withColumn("src", F.lit("rerun")), events.where(part > 2).withColumn("src", F.lit("full"))]
    return by_priority(levels, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def q_allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(allowed, "o_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_missing_anti(spark: SparkSession, d: str) -> DataFrame:
    """Expected keys without a result."""
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left_anti")


@query(
    """SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(toxic) > 0.15)
    AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""
)
def q_holdout_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Leaves out held-out classes, then held-out ids."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels")
    classes = docs.join(labels, "doc_id").groupBy("source").agg(F.avg("toxic").alias("rate")).where("rate > 0.15")
    return docs.join(classes, "source", "left_anti").join(labels.where("quality = 0"), "doc_id", "left_anti").select("doc_id", "source", "lang")


@query("SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_type HAVING count(*) > 12")
def q_having_freq(spark: SparkSession, d: str) -> DataFrame:
    """Counts by part before the join, so that the join carries a row for each part."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").join(lines, "p_partkey").groupBy("p_brand", "p_type").agg(F.sum("n").alias("n")).where("n > 12")


@query(
    """SELECT event_type, CAST(count(*) FILTER (user_id % 2 = 0) AS BIGINT) AS n_face, CAST(count(*) FILTER (user_id % 2 = 1) AS BIGINT) AS n_edge,
    round(avg(value) FILTER (user_id % 2 = 0), 6) AS face_value, round(avg(value) FILTER (user_id % 2 = 1), 6) AS edge_value,
    round(avg(CAST(json_extract(props, '$.k') AS INT)) FILTER (user_id % 2 = 0), 6) AS face_k, round(avg(CAST(json_extract(props, '$.k') AS INT)) FILTER (user_id % 2 = 1), 6) AS edge_k
    FROM events GROUP BY event_type"""
)
def q_config_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of each metric by configuration, one column for each kind of entity, in one pass."""
    face, k = F.col("user_id") % 2 == 0, F.get_json_object("props", "$.k").cast("int")
    mean = lambda c, on: F.round(F.avg(F.when(on, c)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(face).alias("n_face"), F.count_if(~face).alias("n_edge"), mean(F.col("value"), face).alias("face_value"), mean(F.col("value"), ~face).alias("edge_value"), mean(k, face).alias("face_k"), mean(k, ~face).alias("edge_k")
    )


@query(
    """SELECT p_brand, f AS returnflag, CAST(count(l_partkey) AS BIGINT) AS n, CASE WHEN count(l_partkey) > 0 THEN round(sum(l_discount) / count(l_partkey), 6) ELSE 0.0 END AS mean_discount
    FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) t(f)
    LEFT JOIN (SELECT p_brand AS b, l_returnflag, l_partkey, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45) ON b = p_brand AND l_returnflag = f GROUP BY p_brand, f"""
)
def q_means_empty_zero(spark: SparkSession, d: str) -> DataFrame:
    """Running sum over count where a group without rows gives 0, not null. The expected groups are brands by four flags."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    expected = part.select("p_brand").distinct().withColumn("returnflag", F.explode(F.array(*map(F.lit, "ANRX"))))
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("returnflag"), "l_discount")
    sums = lines.join(part, "p_partkey").groupBy("p_brand", "returnflag").agg(F.count("*").alias("n"), F.sum("l_discount").alias("total"))
    return expected.join(sums, ["p_brand", "returnflag"], "left").select("p_brand", "returnflag", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 6)).otherwise(0.0).alias("mean_discount"))


@query(
    """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS expected, CAST(count(k) AS BIGINT) AS covered, round(count(k) / count(*), 6) AS share
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON k = c_custkey GROUP BY c_mktsegment"""
)
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many expected keys have a result, by kind."""
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("k", F.lit(1))
    return table(spark, d, "customer").join(seen, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("expected"), F.count("k").alias("covered"), F.round(F.count("k") / F.count("*"), 6).alias("share"))


@query(
    """WITH r AS (SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey) AS ranked, min(l_partkey) AS marked FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN pos IS NULL THEN 'none' WHEN pos >= 4 THEN '4+' ELSE CAST(pos AS VARCHAR) END AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(list_position(ranked, marked), 0) - 1 AS pos FROM r) GROUP BY 1"""
)
def q_rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Where the marked element stands in each ranked list (from 0, first occurrence), with an overflow bucket."""
    by_price = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey")))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(by_price.alias("ranked"), F.min("l_partkey").alias("marked"))
    pos = F.nullif(F.array_position(F.col("ranked.l_partkey"), F.col("marked")), F.lit(0)) - 1
    bucket = F.when(F.col("pos").isNull(), "none").when(F.col("pos") >= 4, "4+").otherwise(F.col("pos").cast("string"))
    return lists.select(pos.alias("pos")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """SELECT coalesce(o_orderpriority, 'all') AS priority, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (r <= 1) AS BIGINT) AS within_1, CAST(count(*) FILTER (r <= 3) AS BIGINT) AS within_3, CAST(count(*) FILTER (r <= 5) AS BIGINT) AS within_5
    FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY GROUPING SETS ((o_orderpriority), ())"""
)
def q_within_topk_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts within the top 1, 3 and 5, by kind and overall."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = table(spark, d, "orders").select("o_orderpriority", rank.alias("r"))
    return ranked.rollup("o_orderpriority").agg(F.count("*").alias("n"), *[F.count_if(F.col("r") <= k).alias(f"within_{k}") for k in (1, 3, 5)]).select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "within_1", "within_3", "within_5")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, CAST(grouping(date_trunc('day', ts)) AS BIGINT) * 2 + grouping(event_type) AS level FROM events GROUP BY ROLLUP (date_trunc('day', ts), event_type)")
def q_rollup_daily(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return events.rollup("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().cast(LONG).alias("level"))


@query("SELECT user_id, event_type, CAST(bit_or(CAST(1 AS BIGINT) << CAST(hour(ts) AS INT)) AS BIGINT) AS hours, CAST(bit_count(bit_or(CAST(1 AS BIGINT) << CAST(hour(ts) AS INT))) AS BIGINT) AS n_hours FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type")
def q_or_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of bit masks by owner and label, one label left out."""
    mask = F.bit_or(F.expr("shiftleft(1L, hour(ts))"))
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id", "event_type").agg(mask.alias("hours"), F.bit_count(mask).cast(LONG).alias("n_hours"))


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT x.p_type AS type_a, y.p_type AS type_b, x.l_returnflag AS relation, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag AND x.p_type < y.p_type GROUP BY ALL)
    SELECT type_a, type_b, relation, CAST(n AS BIGINT) AS n, round((n + 1) / (sum(n + 1) OVER (PARTITION BY type_a, relation)), 6) AS share FROM c"""
)
def q_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """How often two classes stand in a relation, smoothed by one and normalised by row; an order has at most six types."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    sets = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(part, "l_partkey").groupBy("l_orderkey", F.col("l_returnflag").alias("relation")).agg(F.collect_set("p_type").alias("s"))
    pairs = sets.select("relation", "s", F.explode("s").alias("type_a")).select("relation", "type_a", F.explode(F.filter("s", lambda x: x > F.col("type_a"))).alias("type_b"))
    counts = pairs.groupBy("type_a", "type_b", "relation").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round((F.col("n") + 1) / F.sum(F.col("n") + 1).over(Window.partitionBy("type_a", "relation")), 6))


@query(
    """SELECT r_name, s AS segment, n_name, job, job % 4 AS slot FROM (SELECT r_name, s, n_name, row_number() OVER (ORDER BY r_name, n_name, s) - 1 AS job
    FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer))"""
)
def q_cross_jobs(spark: SparkSession, d: str) -> DataFrame:
    """All configurations as jobs, dealt round robin. The dimensions are fixed: 25 nations by the segments, kept as one set."""
    segments = table(spark, d, "customer").agg(F.collect_set("c_mktsegment").alias("all_segments"))
    places = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("one", F.lit(1))
    jobs = places.join(segments.withColumn("one", F.lit(1)), "one").select("r_name", "n_name", F.explode("all_segments").alias("segment"))
    job = (F.row_number().over(Window.orderBy("r_name", "n_name", "segment")) - 1).cast(LONG)
    return jobs.withColumn("job", job).withColumn("slot", F.col("job") % 4)


@query(
    """SELECT split, lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (chosen) AS BIGINT) AS n_chosen FROM (
    SELECT lang, lang IN ('en', 'de') AS chosen, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 1 AND toxic = 0 THEN 'train' WHEN quality = 1 THEN 'val' ELSE 'test' END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY split, lang"""
)
def q_split_membership(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the id set that they belong to."""
    labels = table(spark, d, "labels").withColumn("labelled", F.lit(True))
    split = F.when(F.col("labelled").isNull(), "unlabelled").when(F.expr("quality = 1 and toxic = 0"), "train").when(F.col("quality") == 1, "val").otherwise("test")
    joined = table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy(split.alias("split"), "lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isin("en", "de")).alias("n_chosen"))


@query(
    """WITH g AS (SELECT text, min(doc_id) AS component, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
    SELECT doc_id AS node, component FROM documents JOIN g USING (text) WHERE n > 1"""
)
def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Documents that copies link: connected components of the graph of exact duplicates, over all documents.

    Each copy is linked to the first one of its text and to the last one, so that components need several steps.
    """
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("key"))
    ends = docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    links = docs.join(ends, "key")
    return connected_components(links.select(F.col("doc_id").alias("a"), F.col("last").alias("b")).unionByName(links.select(F.col("first").alias("a"), F.col("last").alias("b"))))


@query(
    """WITH c AS (SELECT user_id AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events WHERE event_type = 'purchase')
    SELECT c_custkey, round(coalesce(v, c_acctbal), 2) AS balance, v IS NOT NULL AS changed FROM customer LEFT JOIN (SELECT * FROM c WHERE nth = 1) ON k = c_custkey
    UNION ALL SELECT k, round(v, 2), true FROM c WHERE nth = 1 AND k NOT IN (SELECT c_custkey FROM customer)"""
)
def q_upsert_last(spark: SparkSession, d: str) -> DataFrame:
    """Predictions merged by id, the last writer wins."""
    base = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"), F.lit(False).alias("changed"), F.lit(-1).cast(LONG).alias("turn"))
    changes = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.round("value", 2).alias("balance"), F.lit(True).alias("changed"), F.col("event_id").alias("turn"))
    return upsert(base, changes, ["c_custkey"], F.desc("turn")).drop("turn")


@query(
    """WITH a AS (SELECT l_returnflag AS k, round(avg(l_discount), 3) AS got FROM lineitem GROUP BY 1), g AS (SELECT l_returnflag AS k, round(avg(l_discount), 3) AS want FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
    SELECT k, got, want, CASE WHEN abs(got - want) <= 5e-4 THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM a FULL JOIN g USING (k)"""
)
def q_golden_check(spark: SparkSession, d: str) -> DataFrame:
    """Means against expected means: equal within 5e-4 after rounding to three places."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"))
    both = lines.agg(F.round(F.avg("l_discount"), 3).alias("got"), F.round(F.avg(F.when(F.col("l_linenumber") <= 3, F.col("l_discount"))), 3).alias("want"))
    return both.withColumn("verdict", F.when(F.abs(F.col("got") - F.col("want")) <= 5e-4, "PASS").otherwise("MISMATCH"))


@query(
    """SELECT conv_id, turn, role, n, sentence, coalesce(toxic, -1) AS target FROM (
    SELECT conv_id, turn, role, unnest(range(len(s))) AS n, unnest(s) AS sentence FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS s FROM conversations)) LEFT JOIN labels ON doc_id = conv_id AND turn = 0"""
)
def q_sentence_flatten(spark: SparkSession, d: str) -> DataFrame:
    """One row for each sentence, with its record's target, or -1 where there is none."""
    turns = table(spark, d, "conversations")
    rows = turns.select("conv_id", "turn", "role", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("n", "sentence"))
    targets = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), "toxic", F.lit(0).cast(LONG).alias("turn"))
    return rows.join(targets, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.col("n").cast(LONG).alias("n"), "sentence", F.coalesce("toxic", F.lit(-1)).alias("target"))


@query(
    """SELECT n_nationkey, k AS kind, CASE WHEN l IS NULL THEN '-1' ELSE l || ',-1' END AS boxes FROM nation CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('NOSUCH')) t(k)
    LEFT JOIN (SELECT c_nationkey, c_mktsegment, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal DESC, c_custkey) AS l FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) ON c_nationkey = n_nationkey AND c_mktsegment = k"""
)
def q_group_with_sentinel(spark: SparkSession, d: str) -> DataFrame:
    """Lists by label in score order, each closed by a sentinel; labels without rows keep the sentinel alone."""
    labels = table(spark, d, "nation").select(F.col("n_nationkey"), F.explode(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "NOSUCH")))).alias("kind"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("s"), "c_custkey")))
    lists = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("kind")).agg(ranked.alias("l"))
    return labels.join(lists, ["n_nationkey", "kind"], "left").select("n_nationkey", "kind", F.concat_ws(",", F.col("l.c_custkey").cast("array<string>"), F.lit("-1")).alias("boxes"))


@query(
    """WITH m AS (SELECT p_brand, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    u AS (UNPIVOT m ON quantity, discount, tax INTO NAME metric VALUE v), b AS (SELECT *, max(v) OVER (PARTITION BY metric) AS top FROM u)
    SELECT metric, min(p_brand) AS best, max(top) AS value FROM b WHERE v >= top - 1e-9 GROUP BY metric"""
)
def q_best_per_col(spark: SparkSession, d: str) -> DataFrame:
    """The best configuration of each column; within 1e-9 the preferred (first) name wins."""
    means = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_discount", "l_tax").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    means = means.groupBy("p_brand").agg(*[F.round(F.avg(f"l_{c}"), 6).alias(c) for c in ("quantity", "discount", "tax")])
    long = means.unpivot("p_brand", ["quantity", "discount", "tax"], "metric", "v").withColumn("top", F.max("v").over(Window.partitionBy("metric")))
    return long.where("v >= top - 1e-9").groupBy("metric").agg(F.min("p_brand").alias("best"), F.max("top").alias("value"))


@query("SELECT source, lang, doc_id AS first_doc, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def q_distinct_first_seen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("first_doc"), "n_chars")
    return keep_first(docs, ["source", "lang"], F.col("first_doc"))


@query(
    """SELECT user_id, event_type AS label, CAST(n AS BIGINT) AS n, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS total
    FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL)) WHERE r = 1"""
)
def q_majority_label(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of each group, one label ignored, the lowest on ties, with its share."""
    counts = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("total"))
    return best.select("user_id", "b.label", (-F.col("b.m")).alias("n"), F.round(-F.col("b.m") / F.col("total"), 6).alias("share"))


@query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS n_sources, round(avg(m), 6) AS macro_mean, round(sum(s) / sum(n), 6) AS micro_mean FROM (
    SELECT lang, source, avg(quality) AS m, sum(quality) AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source) GROUP BY lang"""
)
def q_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean over categories of each category's mean, beside the plain mean."""
    joined = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    by = joined.groupBy("lang", "source").agg(F.avg("quality").alias("m"), F.sum("quality").alias("s"), F.count("*").alias("n"))
    return by.groupBy("lang").agg(F.count("*").alias("n_sources"), F.round(F.avg("m"), 6).alias("macro_mean"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro_mean"))


@query(
    """SELECT c_custkey, CAST(len(list_intersect(a, b)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS either, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS iou
    FROM (SELECT o_custkey AS c_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def q_set_iou(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over union of a predicted and a true element set."""
    own = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(own("F").alias("a"), own("O").alias("b")).where("size(a) > 0 and size(b) > 0")
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return sets.select("c_custkey", both.cast(LONG).alias("both"), either.cast(LONG).alias("either"), F.round(both / either, 6).alias("iou"))

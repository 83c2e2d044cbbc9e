"""Geometry, part metrics, matching and splits on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import bucket
from ..session import table
from .catalog import query
from .evaluation import detections
from .texts import HASH

LONG = "bigint"


@query(
    """WITH p AS (SELECT l_orderkey, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y FROM lineitem),
    c AS (SELECT l_orderkey, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(x * x) - avg(x) * avg(x) AS xx, avg(y * y) - avg(y) * avg(y) AS yy, avg(x * y) - avg(x) * avg(y) AS xy FROM p GROUP BY 1)
    SELECT l_orderkey, CAST(n AS BIGINT) AS n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(xx, 3) AS xx, round(yy, 3) AS yy, round(xy, 3) AS xy, round((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + pow(xy, 2)), 3) AS longest FROM c"""
)
def q_component_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size, centroid and covariance of each component, with the larger eigenvalue."""
    p = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"))
    var = lambda a, b: (F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(a + b)
    s = p.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), var("x", "x"), var("y", "y"), var("x", "y"))
    longest = (F.col("xx") + F.col("yy")) / 2 + F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.pow("xy", F.lit(2)))
    return s.select("l_orderkey", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), *[F.round(c, 3).alias(c) for c in ("xx", "yy", "xy")], F.round(longest, 3).alias("longest"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) FILTER (value > 30) / count(*) AS ratio FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END, ratio DESC, event_type) AS k FROM c WHERE ratio >= 0.3)
    SELECT user_id, event_type AS label, round(ratio, 6) AS ratio FROM r WHERE k = 1"""
)
def q_priority_label(spark: SparkSession, d: str) -> DataFrame:
    """The label of each group with enough coverage: preferred names first, then the best covered."""
    cover = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count_if(F.col("value") > 30) / F.count("*")).alias("ratio")).where("ratio >= 0.3")
    best = F.min(F.struct((~F.col("event_type").isin("error", "signup")).alias("late"), (-F.col("ratio")).alias("m"), "event_type")).alias("b")
    return cover.groupBy("user_id").agg(best).select("user_id", F.col("b.event_type").alias("label"), F.round(-F.col("b.m"), 6).alias("ratio"))


@query(
    """WITH c AS (SELECT lang, source, count(*) FILTER (quality = 1 AND toxic = 1) AS i, count(*) FILTER (quality = 0 OR toxic = 1) AS u, count(*) FILTER (toxic = 1) AS gt FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT lang, round(avg(i / u) FILTER (u > 0), 6) AS skipping_empty, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END), 6) AS empty_is_one, round(avg(i / u) FILTER (gt > 0), 6) AS present_only FROM c GROUP BY lang"""
)
def q_part_miou(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap over parts in its three conventions for parts that are absent."""
    c = detections(spark, d).groupBy("lang", "source").agg(F.count_if(F.expr("quality = 1 and toxic = 1")).alias("i"), F.count_if(F.expr("quality = 0 or toxic = 1")).alias("u"), F.count_if(F.col("toxic") == 1).alias("gt"))
    part = F.try_divide("i", "u")
    return c.groupBy("lang").agg(F.round(F.avg(part), 6).alias("skipping_empty"), F.round(F.avg(F.coalesce(part, F.lit(1.0))), 6).alias("empty_is_one"), F.round(F.avg(F.when(F.col("gt") > 0, part)), 6).alias("present_only"))


@query(
    """WITH c AS (SELECT source, count(*) AS n, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1), f AS (SELECT *, CASE WHEN n < 4 THEN 'r' WHEN n < 20 THEN 'c' ELSE 'f' END AS freq FROM c)
    SELECT freq, CAST(count(*) AS BIGINT) AS classes, round(avg(q), 6) AS mean FROM f GROUP BY freq"""
)
def q_frequency_groups(spark: SparkSession, d: str) -> DataFrame:
    """A metric averaged over rare, common and frequent classes."""
    c = detections(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    return c.groupBy(F.when(F.col("n") < 4, "r").when(F.col("n") < 20, "c").otherwise("f").alias("freq")).agg(F.count("*").alias("classes"), F.round(F.avg("q"), 6).alias("mean"))


@query(
    """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS a, l_suppkey % 40 AS b FROM lineitem),
    c AS (SELECT x.l_orderkey AS o, x.a, y.b, abs(x.a - y.b) AS gap FROM (SELECT DISTINCT l_orderkey, a FROM s) x JOIN (SELECT DISTINCT l_orderkey, b FROM s) y ON x.l_orderkey = y.l_orderkey AND abs(x.a - y.b) <= 6),
    r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY gap, a, b) AS k FROM c),
    g AS (SELECT DISTINCT o, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs FROM r
    UNION ALL SELECT g.o, r.k, CASE WHEN list_contains(us, r.a) OR list_contains(vs, r.b) THEN us ELSE list_append(us, r.a) END, CASE WHEN list_contains(us, r.a) OR list_contains(vs, r.b) THEN vs ELSE list_append(vs, r.b) END FROM g JOIN r ON r.o = g.o AND r.k = g.k + 1)
    SELECT o AS l_orderkey, array_to_string(arg_max(us, k), ',') AS left_ids, array_to_string(arg_max(vs, k), ',') AS right_ids FROM g GROUP BY o"""
)
def q_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one matching of two small sets by the nearest pair, up to a limit."""
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("a"), F.collect_set(F.col("l_suppkey") % 40).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: F.abs(x - y) <= 6), lambda y: F.struct(F.abs(x - y).alias("gap"), x.alias("x"), y.alias("y")))))
    start = F.expr("named_struct('us', CAST(array() AS array<bigint>), 'vs', CAST(array() AS array<bigint>))")

    def step(s, p):  # noqa: ANN001, ANN202
        taken = F.array_contains(s["us"], p["x"]) | F.array_contains(s["vs"], p["y"])
        return F.when(taken, s).otherwise(F.struct(F.array_append(s["us"], p["x"]).alias("us"), F.array_append(s["vs"], p["y"]).alias("vs")))

    done = sets.select("l_orderkey", F.array_sort(pairs).alias("p")).where("size(p) > 0").select("l_orderkey", F.aggregate("p", start, step).alias("m"))
    return done.select("l_orderkey", *[F.array_join(F.col(f"m.{c}").cast("array<string>"), ",").alias(n) for c, n in (("us", "left_ids"), ("vs", "right_ids"))])


def spread_sql(v: str) -> str:
    return " + ".join(f"((({v}) >> {i}) & 1) * {1 << (2 * i)}" for i in range(10))


@query(f"SELECT p_partkey, CAST({spread_sql('p_partkey % 1024')} + 2 * ({spread_sql('p_size')}) AS BIGINT) AS morton FROM part")
def q_morton(spark: SparkSession, d: str) -> DataFrame:
    """Z-order: the bits of two coordinates interleaved."""
    spread = lambda c: sum(((F.shiftright(c, i).bitwiseAND(1)) * (1 << (2 * i)) for i in range(10)), F.lit(0).cast(LONG))
    return table(spark, d, "part").select("p_partkey", (spread(F.col("p_partkey") % 1024) + 2 * spread(F.col("p_size").cast(LONG))).alias("morton"))


@query(
    """WITH s AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS s, max(l_discount) AS rel FROM lineitem GROUP BY ALL)
    SELECT x.l_orderkey, CAST(count(*) AS BIGINT) AS pairs, round(avg(greatest(y.s - x.s, 0) / 10 + ln(1 + exp(-abs(y.s - x.s) / 10))), 6) AS loss FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.rel > y.rel GROUP BY 1"""
)
def q_pairwise_loss(spark: SparkSession, d: str) -> DataFrame:
    """Logistic ranking loss over the good-bad pairs of each query, in the form that doesn't overflow; a query has a few items."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("s"), F.max("l_discount").alias("rel"))
    lists = items.groupBy("l_orderkey").agg(F.collect_list(F.struct("s", "rel")).alias("i"))
    pairs = lists.select("l_orderkey", "i", F.explode("i").alias("x")).select("l_orderkey", "x", F.explode(F.filter("i", lambda y: y["rel"] < F.col("x.rel"))).alias("y"))
    gap = (F.col("y.s") - F.col("x.s")) / 10
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.round(F.avg(F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))), 6).alias("loss"))


@query(
    """WITH t AS (SELECT l_orderkey, l_partkey % 100 AS ux, l_suppkey % 100 AS uy, l_linenumber AS uz, l_quantity AS vx, l_linenumber * 3 AS vy, l_partkey % 7 AS vz FROM lineitem)
    SELECT l_orderkey, round(sum(sqrt(pow(uy * vz - uz * vy, 2) + pow(uz * vx - ux * vz, 2) + pow(ux * vy - uy * vx, 2)) / 2), 4) AS area FROM t GROUP BY 1"""
)
def q_triangle_area(spark: SparkSession, d: str) -> DataFrame:
    """Surface of each mesh: half the length of the cross product of each triangle's sides."""
    rows = table(spark, d, "lineitem").select("l_orderkey", *[F.expr(e).cast("double").alias(n) for n, e in {"ux": "l_partkey % 100", "uy": "l_suppkey % 100", "uz": "l_linenumber", "vx": "l_quantity", "vy": "l_linenumber * 3", "vz": "l_partkey % 7"}.items()])
    cross = F.expr("sqrt(pow(uy * vz - uz * vy, 2) + pow(uz * vx - ux * vz, 2) + pow(ux * vy - uy * vx, 2)) / 2")
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(cross), 4).alias("area"))


@query(
    """WITH q AS (SELECT DISTINCT l_orderkey, CAST(round_even(l_extendedprice / 5000, 0) AS BIGINT) AS cell FROM lineitem)
    SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, CAST(v AS BIGINT) AS vertex FROM lineitem l JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cell) AS v FROM q) q ON q.l_orderkey = l.l_orderkey AND cell = CAST(round_even(l_extendedprice / 5000, 0) AS BIGINT)"""
)
def q_quantize_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Vertices within a tolerance become one, numbered within their mesh."""
    cell = F.rint(F.col("l_extendedprice") / 5000).cast(LONG)
    vertex = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(cell))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", vertex.cast(LONG).alias("vertex"))


@query("SELECT conv_id, turn, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) < floor(count(*) OVER (PARTITION BY conv_id) * 0.8) THEN 'train' ELSE 'val' END AS split, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations")
def q_ratio_split(spark: SparkSession, d: str) -> DataFrame:
    """The first four fifths of each list and the rest; and the list in chunks of three."""
    seq, n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1, F.count("*").over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(seq < F.floor(n * 0.8), "train").otherwise("val").alias("split"), F.floor(seq / 3).cast(LONG).alias("chunk"))


@query(f"SELECT doc_id, CASE WHEN {HASH.format('CAST(doc_id AS VARCHAR)')} % 10 < 5 THEN 'a' WHEN {HASH.format('CAST(doc_id AS VARCHAR)')} % 10 < 8 THEN 'b' ELSE 'c' END AS part, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS shape FROM documents")
def q_weighted_pick(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to sets in the ratio 5 : 3 : 2, with the batch that their length belongs to."""
    b = bucket(F.col("doc_id"), 10)
    return table(spark, d, "documents").select("doc_id", F.when(b < 5, "a").when(b < 8, "b").otherwise("c").alias("part"), F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2).alias("shape"))


@query(
    """WITH e AS (SELECT label, vec_id % 7 AS view, embedding FROM embeddings), u AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM e)
    SELECT label, CAST(i AS INT) AS i, round(sum(CAST(v AS DOUBLE)), 4) AS total, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS n FROM u GROUP BY ALL"""
)
def q_feature_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Sums and counts of features over all views, zeros left out of the count."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.round(F.sum(F.col("v").cast("double")), 4).alias("total"), F.count_if(F.col("v") != 0).alias("n"))

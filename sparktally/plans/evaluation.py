"""Evaluation metrics: overlaps, ranked precision and recall, boxes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.boxes import greedy_keep, iou, suppress
from ..operators.ranking import average_precision, precision_at_recalls, precision_recall, score_levels
from ..operators.vectors import centroids, exact_nearest
from ..session import table
from .catalog import query

LONG = "bigint"
POINTS = [round(i / 10, 1) for i in range(11)]


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as detections: class, score and whether it is a hit."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id")


CURVE = """WITH l AS (SELECT lang, n_chars AS score, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality <> 1) AS fp FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS hits, sum(tp) OVER w / sum(tp + fp) OVER w AS precision, sum(tp) OVER (PARTITION BY lang) AS npos FROM l WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN npos > 0 THEN hits / npos END AS recall, max(precision) OVER (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c),
a AS (SELECT lang, max(npos) AS npos, sum((recall - prev) * envelope) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY lang ORDER BY score DESC), 0) AS prev FROM r) GROUP BY lang)
"""


def curve(spark: SparkSession, d: str) -> DataFrame:
    return precision_recall(score_levels(detections(spark, d), ["lang"], "score", F.col("quality") == 1), ["lang"], "score")


@query(
    """WITH c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1) AS i, count(*) FILTER (quality = 1 OR toxic = 1) AS u, count(*) FILTER (toxic = 1) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT coalesce(source, 'all') AS source, CAST(sum(i) AS BIGINT) AS inter, CAST(sum(u) AS BIGINT) AS uni, CAST(sum(t) AS BIGINT) AS target, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END), 6) AS giou, round(sum(i) / (sum(u) + 1e-5), 6) AS ciou FROM c GROUP BY ROLLUP (source)"""
)
def q_confusion_iou(spark: SparkSession, d: str) -> DataFrame:
    """Intersections and unions by item; the mean of the items' overlap (1 where both are empty) and the overlap of the sums."""
    one = detections(spark, d).groupBy("source").agg(F.count_if(F.expr("quality = 1 and toxic = 1")).alias("i"), F.count_if(F.expr("quality = 1 or toxic = 1")).alias("u"), F.count_if(F.col("toxic") == 1).alias("t"))
    return one.rollup("source").agg(
        F.sum("i").alias("inter"), F.sum("u").alias("uni"), F.sum("t").alias("target"), F.round(F.avg(F.coalesce(F.try_divide("i", "u"), F.lit(1.0))), 6).alias("giou"), F.round(F.sum("i") / (F.sum("u") + 1e-5), 6).alias("ciou")
    ).withColumn("source", F.coalesce("source", F.lit("all")))


@query(CURVE + "SELECT lang, CAST(npos AS BIGINT) AS npos, round(ap, 6) AS ap FROM a")
def q_voc_ap(spark: SparkSession, d: str) -> DataFrame:
    """Area form of average precision by class; equal scores are one threshold."""
    return average_precision(curve(spark, d), ["lang"], "score").withColumn("ap", F.round("ap", 6))


@query(CURVE + "SELECT lang, round(sum(p) / 11, 6) AS ap11 FROM (SELECT lang, t / 10.0 AS t, coalesce(max(precision) FILTER (recall >= t / 10.0), 0) AS p FROM r, range(0, 11) g(t) GROUP BY ALL) GROUP BY lang")
def q_ap11(spark: SparkSession, d: str) -> DataFrame:
    """Eleven-point form: the mean of the best precision at recall 0, 0.1, ... 1."""
    return precision_at_recalls(curve(spark, d), ["lang"], POINTS).groupBy("lang").agg(F.round(F.sum("precision") / 11, 6).alias("ap11"))


@query(CURVE + "SELECT CAST(count(*) AS BIGINT) AS n_classes, round(avg(ap), 6) AS mean_ap, round(sum(ap * npos) / sum(npos), 6) AS weighted_ap FROM a")
def q_weighted_map(spark: SparkSession, d: str) -> DataFrame:
    ap = average_precision(curve(spark, d), ["lang"], "score")
    return ap.agg(F.count("*").alias("n_classes"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.sum(F.col("ap") * F.col("npos")) / F.sum("npos"), 6).alias("weighted_ap"))


@query(
    """WITH t(thr) AS (VALUES (500), (1500), (4000)), l AS (SELECT thr, lang, n_chars AS score, count(*) FILTER (quality = 1 AND n_chars >= thr) AS tp, count(*) FILTER (NOT (quality = 1 AND n_chars >= thr)) AS fp FROM documents JOIN labels USING (doc_id), t GROUP BY ALL),
    c AS (SELECT *, sum(tp) OVER w AS hits, sum(tp) OVER w / sum(tp + fp) OVER w AS precision, sum(tp) OVER (PARTITION BY thr, lang) AS npos FROM l WINDOW w AS (PARTITION BY thr, lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT thr, lang, p / 10.0 AS point, round(coalesce(max(precision) FILTER (hits / nullif(npos, 0) >= p / 10.0), 0), 6) AS precision FROM c, range(0, 11) g(p) GROUP BY ALL"""
)
def q_ap_grid(spark: SparkSession, d: str) -> DataFrame:
    """Precision over thresholds by recall points by class; 0 where the recall isn't reached."""
    rows = detections(spark, d).withColumn("thr", F.explode(F.array(F.lit(500), F.lit(1500), F.lit(4000))))
    levels = score_levels(rows, ["thr", "lang"], "score", (F.col("quality") == 1) & (F.col("score") >= F.col("thr")))
    return precision_at_recalls(precision_recall(levels, ["thr", "lang"], "score"), ["thr", "lang"], POINTS).withColumn("precision", F.round("precision", 6))


NEAR = """WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT q.vec_id AS query_id, q.label AS query_label, x.vec_id, x.label, round(list_cosine_similarity(q.e, CAST(x.embedding AS DOUBLE[])), 9) AS s FROM q JOIN embeddings x ON x.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM n QUALIFY rank <= 10)
"""


def near(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every fiftieth vector, with both labels."""
    rows = table(spark, d, "embeddings")
    found = exact_nearest(rows, rows.where("vec_id % 50 = 0"), 10)
    own, other = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), rows.select("vec_id", "label")
    return found.join(own, "query_id").join(other, "vec_id")


@query(NEAR + "SELECT query_id, rank, vec_id, round(s, 6) AS score FROM k WHERE rank <= 5")
def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).where("rank <= 5").select("query_id", F.col("rank").cast(LONG).alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(NEAR + "SELECT least(query_id, vec_id) AS src, greatest(query_id, vec_id) AS dst, round(max(1 - s), 6) AS dist, CAST(count(*) AS BIGINT) AS directions FROM k GROUP BY ALL")
def q_knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour lists as undirected edges."""
    return near(spark, d).groupBy(F.least("query_id", "vec_id").alias("src"), F.greatest("query_id", "vec_id").alias("dst")).agg(F.round(F.max(1 - F.col("score")), 6).alias("dist"), F.count("*").alias("directions"))


@query(
    NEAR + """SELECT coalesce(CAST(query_label AS VARCHAR), 'all') AS label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS r10
    FROM (SELECT query_id, query_label, min(rank) FILTER (label = query_label) AS first FROM k GROUP BY ALL) GROUP BY ROLLUP (query_label)"""
)
def q_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of queries with a neighbour of their label among the first k, by label and overall."""
    first = near(spark, d).groupBy("query_id", "query_label").agg(F.min(F.when(F.col("label") == F.col("query_label"), F.col("rank"))).alias("first"))
    within = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}")
    return first.rollup("query_label").agg(F.count("*").alias("n"), within(1), within(5), within(10)).select(F.coalesce(F.col("query_label").cast("string"), F.lit("all")).alias("label"), "n", "r1", "r5", "r10")


@query(
    NEAR + """, b AS (SELECT query_id, query_label, coalesce(max(s) FILTER (label = query_label), -1) AS best FROM k GROUP BY ALL)
    SELECT query_label AS label, round(avg((SELECT count(*) FROM (VALUES (0.1), (0.15), (0.2), (0.25), (0.3), (0.35), (0.4), (0.45), (0.5)) t(x) WHERE best >= CAST(x AS DOUBLE)) / 9), 6) AS average_recall FROM b GROUP BY query_label"""
)
def q_avg_recall_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Recall averaged over similarity thresholds."""
    best = near(spark, d).groupBy("query_id", "query_label").agg(F.coalesce(F.max(F.when(F.col("label") == F.col("query_label"), F.col("score"))), F.lit(-1.0)).alias("best"))
    passed = F.size(F.filter(F.array(*[F.lit(x / 100) for x in range(10, 55, 5)]), lambda x: x <= F.col("best")))
    return best.groupBy(F.col("query_label").alias("label")).agg(F.round(F.avg(passed / 9), 6).alias("average_recall"))


@query("WITH u AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS mean FROM u GROUP BY ALL) SELECT label, CAST(i AS INT) AS i, round(mean, 6) AS mean, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS unit FROM m")
def q_label_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each label's mean vector, and scaled to length 1."""
    return centroids(table(spark, d, "embeddings").select("label", "embedding"), "label").withColumns({"mean": F.round("mean", 6), "unit": F.round("unit", 6)})


@query(
    """WITH w AS (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS tp, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS pred, sum(l_extendedprice) FILTER (l_linestatus = 'F') AS gt FROM lineitem GROUP BY 1),
    m AS (SELECT l_orderkey, coalesce(tp, 0) AS tp, coalesce(pred, 0) AS pred, coalesce(gt, 0) AS gt FROM w)
    SELECT l_orderkey, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 6) AS precision, round(CASE WHEN gt > 0 THEN tp / gt ELSE 0 END, 6) AS recall, round(CASE WHEN pred + gt - tp > 0 THEN tp / (pred + gt - tp) ELSE 0 END, 6) AS iou, round(CASE WHEN pred + gt > 0 THEN 2 * tp / (pred + gt) ELSE 0 END, 6) AS f1 FROM m"""
)
def q_weighted_prf(spark: SparkSession, d: str) -> DataFrame:
    """Overlap metrics with each element weighed, 0 where nothing is to divide by."""
    weight = lambda on: F.coalesce(F.sum(F.when(F.expr(on), F.col("l_extendedprice"))), F.lit(0.0))
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(weight("l_returnflag = 'A' and l_linestatus = 'F'").alias("tp"), weight("l_returnflag = 'A'").alias("pred"), weight("l_linestatus = 'F'").alias("gt"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, pred, gt = F.col("tp"), F.col("pred"), F.col("gt")
    return sums.select("l_orderkey", ratio(tp, pred).alias("precision"), ratio(tp, gt).alias("recall"), ratio(tp, pred + gt - tp).alias("iou"), ratio(2 * tp, pred + gt).alias("f1"))


#: Boxes of an order: its distinct (part, line) pairs, placed by the part's number and sized by line number.
BOX_SQL = """b AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, CAST(l_partkey % 97 AS DOUBLE) AS x1, CAST(l_partkey % 89 AS DOUBLE) AS y1, CAST(l_partkey % 97 + 20 + 5 * l_linenumber AS DOUBLE) AS x2, CAST(l_partkey % 89 + 60 AS DOUBLE) AS y2 FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS k FROM b)"""
KIND = "array<struct<l_partkey:bigint,l_linenumber:int,box:struct<x1:double,y1:double,x2:double,y2:double>>>"


def order_boxes(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, ranked): each order's boxes, best first; an order has a few lines."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    x, y = (part % 97).cast("double"), (part % 89).cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 20 + 5 * line).alias("x2"), (y + 60).alias("y2")).alias("box")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_partkey", "l_linenumber", box))).alias("ranked"))


def iou_sql(a: str, b: str, pixel: int = 0) -> str:
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {pixel}) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {pixel})"
    size = lambda t: f"({t}.x2 - {t}.x1 + {pixel}) * ({t}.y2 - {t}.y1 + {pixel})"
    return f"({w}) / ({size(a)} + {size(b)} - {w})"


@query(f"WITH {BOX_SQL} SELECT p.l_orderkey, CAST(p.k AS INT) AS i, CAST(q.k AS INT) AS j, round({iou_sql('p', 'q')}, 6) AS iou FROM r p JOIN r q ON p.l_orderkey = q.l_orderkey AND p.k < q.k WHERE {iou_sql('p', 'q')} > 0")
def q_box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of the boxes of one order, pair by pair (an order has a few lines)."""
    rows = order_boxes(spark, d).select("l_orderkey", F.posexplode("ranked").alias("i", "a"), "ranked")
    pairs = rows.select("l_orderkey", (F.col("i") + 1).alias("i"), "a", F.posexplode("ranked").alias("j", "b")).where("j >= i").withColumn("j", F.col("j") + 1)
    return pairs.select("l_orderkey", "i", "j", F.round(iou(F.col("a.box"), F.col("b.box")), 6).alias("iou")).where("iou > 0")


def greedy_sql(limit: str) -> str:
    """Keeps boxes in order unless they clash with a kept one."""
    return f"""WITH RECURSIVE {BOX_SQL}, g AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT l_orderkey FROM r)
    UNION ALL SELECT g.l_orderkey, r.k, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.l_orderkey = r.l_orderkey AND list_contains(g.kept, o.k) AND {limit}) THEN g.kept ELSE list_append(g.kept, r.k) END FROM g JOIN r ON r.l_orderkey = g.l_orderkey AND r.k = g.k + 1)
    SELECT l_orderkey, CAST(max(len(kept)) AS BIGINT) AS n_kept, arg_max(array_to_string(kept, ','), k) AS kept FROM g GROUP BY l_orderkey"""


@query(greedy_sql(f"{iou_sql('r', 'o', 1)} >= 0.3"))
def q_box_nms(spark: SparkSession, d: str) -> DataFrame:
    """Suppression of overlapping boxes, with the pixel convention; the places of the kept boxes."""
    ranked = order_boxes(spark, d).withColumn("kept", suppress(F.col("ranked"), KIND, 0.3, 1.0))
    return ranked.select("l_orderkey", F.size("kept").cast(LONG).alias("n_kept"), F.concat_ws(",", F.transform("kept", lambda x: F.array_position("ranked", x).cast("string"))).alias("kept"))


@query(greedy_sql("abs(r.x1 - o.x1) < 30"))
def q_greedy_nms_angle(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of views at least 30 apart: strictly nearer ones go."""
    ranked = order_boxes(spark, d).withColumn("kept", greedy_keep(F.col("ranked"), KIND, lambda k, x: F.abs(k["box"]["x1"] - x["box"]["x1"]) < 30))
    return ranked.select("l_orderkey", F.size("kept").cast(LONG).alias("n_kept"), F.concat_ws(",", F.transform("kept", lambda x: F.array_position("ranked", x).cast("string"))).alias("kept"))


@query(
    f"""WITH {BOX_SQL} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(x1 * l_linenumber) / sum(l_linenumber), 6) AS x1, round(sum(y1 * l_linenumber) / sum(l_linenumber), 6) AS y1,
    round(sum(x2 * l_linenumber) / sum(l_linenumber), 6) AS x2, round(sum(y2 * l_linenumber) / sum(l_linenumber), 6) AS y2, max(l_linenumber) AS score, round((max(x2) - min(x1)) * (max(y2) - min(y1)), 6) AS hull FROM r GROUP BY 1"""
)
def q_box_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Score-weighted corners, the best score and the area of the bounding box."""
    rows = order_boxes(spark, d).select("l_orderkey", F.explode("ranked").alias("r")).select("l_orderkey", "r.l_linenumber", "r.box.*")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("l_linenumber")) / F.sum("l_linenumber"), 6).alias(c)
    hull = (F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), mean("x1"), mean("y1"), mean("x2"), mean("y2"), F.max("l_linenumber").alias("score"), F.round(hull, 6).alias("hull"))


@query(
    """WITH s AS (SELECT c_nationkey, c_mktsegment, c_acctbal, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r, c_custkey, abs(c_acctbal - s_acctbal) AS gap FROM customer JOIN supplier ON s_nationkey = c_nationkey)
    SELECT c_custkey, s_suppkey, round(gap, 4) AS gap, CASE WHEN gap < 500 THEN 1 WHEN gap < 2000 THEN -2 ELSE -1 END AS matched FROM s WHERE r = 1"""
)
def q_best_match_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each prediction, judged by two thresholds: matched, between, below.

    Nearest balances by bands: within a nation's band two running extremes give the neighbours on either side, and the
    nearest band with a candidate below and above gives its edge; no pairs are made.
    """
    band = lambda c: F.floor(F.col(c) / 100).alias("band")
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), band("c_acctbal"), F.col("c_acctbal").alias("at"), "c_custkey")
    found = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal"), F.col("s_acctbal").alias("at"), "s_suppkey")
    up, down = F.struct("at", F.col("s_suppkey").alias("key")), F.struct("at", (-F.col("s_suppkey")).alias("minus"))
    edges = people.select("nation", "band").distinct().join(found.groupBy("nation", "band").agg(F.min(up).alias("lo"), F.max(down).alias("hi")), ["nation", "band"], "full")
    bands = Window.partitionBy("nation").orderBy("band")
    edges = edges.select("nation", "band", F.last("hi", ignorenulls=True).over(bands.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", ignorenulls=True).over(bands.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    own = Window.partitionBy("nation", "band")
    both = people.withColumn("s_suppkey", F.lit(None).cast(LONG)).unionByName(found.withColumn("c_custkey", F.lit(None).cast(LONG)))
    some = lambda c: F.when(F.col("s_suppkey").isNotNull(), c)
    near = both.withColumns({"below": F.max(some(down)).over(own.orderBy("at")), "above": F.min(some(up)).over(own.orderBy(F.desc("at")))}).where("c_custkey is not null")
    near = near.join(edges, ["nation", "band"])
    gap = lambda c, key: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(c)["at"]).alias("gap"), key.alias("s_suppkey")))
    options = F.array(gap("below", -F.col("below.minus")), gap("before", -F.col("before.minus")), gap("above", F.col("above.key")), gap("after", F.col("after.key")))
    best = near.select("c_custkey", F.array_min(options).alias("b")).where("b is not null")
    return best.select("c_custkey", "b.s_suppkey", F.round("b.gap", 4).alias("gap"), F.when(F.col("b.gap") < 500, 1).when(F.col("b.gap") < 2000, -2).otherwise(-1).alias("matched"))


@query(
    """WITH c AS (SELECT source, lang, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY ALL), s AS (SELECT source, min(m) AS worst, max(m) AS best, avg(m) AS mean, count(*) AS n FROM c GROUP BY 1)
    SELECT source, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(best - worst, 6) AS gap, CAST(dense_rank() OVER (ORDER BY round(mean, 6) DESC) AS BIGINT) AS place FROM s"""
)
def q_rank_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs ranked by their mean over classes, with the spread between classes; one row for each source."""
    one = detections(spark, d).groupBy("source", "lang").agg(F.avg("quality").alias("m"))
    runs = one.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.max("m") - F.min("m"), 6).alias("gap"))
    return runs.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("mean"))).cast(LONG))

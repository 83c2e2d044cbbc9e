"""Ordered analytics: top-k, greedy choices, runs, budgets and prefix sums within bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import islands, top_k
from ..session import table
from .catalog import query

LONG = "bigint"


@query("SELECT event_type, user_id, event_id, value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def q_topk(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    return top_k(events, ["user_id", "event_type"], 3, F.desc("value"), F.col("event_id")).withColumn("rank", F.col("rank").cast(LONG))


@query(
    """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, greatest(1, CAST(round_even(count(*) OVER (PARTITION BY user_id) * 10 / 100, 0) AS BIGINT)) AS n FROM events) WHERE r <= n"""
)
def q_top_pct(spark: SparkSession, d: str) -> DataFrame:
    """The top 10 % of each group, rounded half to even, one at least."""
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    n = F.greatest(F.lit(1), F.bround(F.count("*").over(Window.partitionBy("user_id")) * 10 / 100).cast(LONG))
    return top_k(events.withColumn("n", n), ["user_id"], F.col("n"), F.desc("value"), F.col("event_id")).select("user_id", "event_id", "value")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 2")
def q_kth_ties(spark: SparkSession, d: str) -> DataFrame:
    """All rows at or above the second largest value, ties kept."""
    r = F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", r.alias("r")).where("r <= 2").drop("r")


TIMES = "t AS (SELECT user_id, CAST(ts AS DATE) AS day, list(CAST(epoch_us(ts) AS BIGINT) ORDER BY ts) AS ts FROM events GROUP BY ALL)"


def times(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, day, ts): the times, in microseconds, of a user's events in a day."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(us)).alias("ts"))


@query(
    f"""WITH RECURSIVE {TIMES}, g AS (SELECT user_id, day, ts, 1 AS i, [ts[1]] AS k FROM t UNION ALL SELECT user_id, day, ts, i + 1, CASE WHEN ts[i + 1] - k[-1] < 7200000000 THEN k ELSE list_append(k, ts[i + 1]) END FROM g WHERE i < len(ts))
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(len(k) AS BIGINT) AS n_kept, CAST(list_sum(k) % 1000000007 AS BIGINT) AS digest FROM g WHERE i = len(ts)"""
)
def q_greedy_nms_time(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and day at least two hours after the last one kept."""
    kept = F.aggregate("ts", F.expr("CAST(array() AS array<bigint>)"), lambda k, x: F.when((F.size(k) == 0) | (x - F.try_element_at(k, F.lit(-1)) >= 7200000000), F.array_append(k, x)).otherwise(k))
    total = F.aggregate("k", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return times(spark, d).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), kept.alias("k")).select("user_id", "day", F.size("k").cast(LONG).alias("n_kept"), (total % 1000000007).cast(LONG).alias("digest"))


LINES = "b AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem), v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_partkey) AS k FROM b)"


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, items): each order's distinct (part, quantity), the largest quantity first."""
    item = F.struct((-F.col("l_quantity").cast(LONG)).alias("m"), "l_partkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(item)).alias("items"))


@query(
    f"""WITH RECURSIVE {LINES}, g AS (SELECT l_orderkey, 1 AS n, [l_partkey] AS kept FROM v WHERE k = 1
    UNION ALL SELECT l_orderkey, n + 1, list_append(kept, pick) FROM (SELECT g.l_orderkey, g.n, g.kept, arg_max(v.l_partkey, v.q * 1000000 + 500 * least(200, (SELECT min(abs(v.l_partkey - u) % 200) FROM unnest(g.kept) s(u))) * 1000 - v.l_partkey) AS pick
      FROM g JOIN v ON v.l_orderkey = g.l_orderkey AND NOT list_contains(g.kept, v.l_partkey) WHERE g.n < 3 GROUP BY g.l_orderkey, g.n, g.kept))
    SELECT l_orderkey, array_to_string(arg_max(kept, n), ',') AS kept FROM g GROUP BY l_orderkey"""
)
def q_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Greedy choice of three by score plus distance to what is chosen already."""
    items = order_items(spark, d).select("l_orderkey", F.transform("items", lambda x: F.struct(x["l_partkey"].alias("p"), (-x["m"]).alias("q"))).alias("items"))
    one = items.select("l_orderkey", "items", F.array(F.col("items")[0]["p"]).alias("kept"))
    for _ in range(2):
        gap = lambda x: F.array_min(F.transform("kept", lambda u: F.abs(x["p"] - u) % 200))
        gain = lambda x: x["q"] * 1000000 + F.least(F.lit(200), gap(x)) * 500000 - x["p"]
        best = F.array_max(F.transform(F.filter("items", lambda x: ~F.array_contains("kept", x["p"])), lambda x: F.struct(gain(x).alias("g"), x["p"].alias("p"))))
        one = one.withColumn("best", best).withColumn("kept", F.when(F.col("best").isNull(), F.col("kept")).otherwise(F.array_append("kept", F.col("best.p")))).drop("best")
    return one.select("l_orderkey", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query(
    """WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS k, min(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, k, sum(w) AS w, sum(w) FILTER (l_suppkey % 2 = 0) AS hit FROM f GROUP BY ALL)
    SELECT l_orderkey, k, CAST(sum(w) OVER p AS BIGINT) AS pred, CAST(coalesce(sum(hit) OVER p, 0) AS BIGINT) AS tp, round(coalesce(sum(hit) OVER p, 0) / sum(w) OVER p, 6) AS precision FROM s WINDOW p AS (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING)"""
)
def q_running_union_k(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the union of the first k lists: each element counts from the first list that has it."""
    lines = table(spark, d, "lineitem")
    first = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("k"), F.min(F.col("l_quantity").cast(LONG)).alias("w"))
    steps = first.groupBy("l_orderkey", "k").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("l_suppkey") % 2 == 0, F.col("w"))).alias("hit"))
    p = Window.partitionBy("l_orderkey").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pred, tp = F.sum("w").over(p), F.coalesce(F.sum("hit").over(p), F.lit(0))
    return steps.select("l_orderkey", "k", pred.alias("pred"), tp.alias("tp"), F.round(tp / pred, 6).alias("precision"))


@query("SELECT event_id, user_id, round(avg(value) OVER w, 6) AS mean20, max(value) OVER w AS max20, CAST(count(*) OVER w AS BIGINT) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def q_sliding_stats(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("mean20"), F.max("value").over(w).alias("max20"), F.count("*").over(w).alias("n"))


@query("SELECT conv_id, turn, coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start, CAST(length(text) AS BIGINT) AS size FROM conversations")
def q_prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each piece begins when the pieces are joined by one character."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast(LONG).alias("start"), F.length("text").cast(LONG).alias("size"))


ISLANDS = "n AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)"


@query(f"WITH {ISLANDS} SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_event FROM i GROUP BY user_id, run")
def q_islands(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return islands(events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"WITH {ISLANDS}, r AS (SELECT user_id, run, min(event_type) AS t, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, string_agg(t || ':' || n, ' ' ORDER BY run) AS rle, CAST(sum(n) FILTER (t = 'error') AS BIGINT) AS covered FROM r GROUP BY user_id")
def q_rle(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sequence of event types as run lengths, and what one label covers."""
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    runs = islands(events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("t"), F.count("*").alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("run", "t", "n"))), lambda r: F.concat_ws(":", r["t"], r["n"].cast("string")))
    return runs.groupBy("user_id").agg(F.array_join(texts, " ").alias("rle"), F.sum(F.when(F.col("t") == "error", F.col("n"))).alias("covered"))


TOKENS = "w AS (SELECT conv_id, turn, role, len(string_split(text, ' ')) AS n FROM conversations)"


@query(f"WITH {TOKENS} SELECT conv_id, turn, CAST(n AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM w) WHERE used <= 300")
def q_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns up to a budget of words, stopping at the first that doesn't fit."""
    n = F.size(F.split("text", " ")).cast(LONG)
    used = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n")).withColumn("used", used).where("used <= 300").drop("used")


@query(
    f"""WITH RECURSIVE {TOKENS}, l AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list(n ORDER BY turn) AS sizes FROM w GROUP BY conv_id),
    g AS (SELECT conv_id, turns, sizes, 0 AS i, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS kept FROM l
    UNION ALL SELECT conv_id, turns, sizes, i + 1, CASE WHEN used + sizes[i + 1] <= 250 THEN used + sizes[i + 1] ELSE used END, CASE WHEN used + sizes[i + 1] <= 250 THEN list_append(kept, turns[i + 1]) ELSE kept END FROM g WHERE i < len(turns))
    SELECT conv_id, used, array_to_string(kept, ',') AS kept FROM g WHERE i = len(turns)"""
)
def q_budget_skip(spark: SparkSession, d: str) -> DataFrame:
    """Turns packed into a budget: one that doesn't fit is skipped, later ones may fit."""
    item = F.struct("turn", F.size(F.split("text", " ")).cast(LONG).alias("n"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast(LONG).alias("used"), F.expr("CAST(array() AS array<bigint>)").alias("kept"))
    fits = lambda s, x: s["used"] + x["n"] <= 250
    packed = F.aggregate("items", start, lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["n"]).alias("used"), F.array_append(s["kept"], x["turn"]).alias("kept"))).otherwise(s))
    return lists.select("conv_id", packed.alias("p")).select("conv_id", "p.used", F.array_join(F.col("p.kept").cast("array<string>"), ",").alias("kept"))


@query(
    """WITH RECURSIVE l AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
    g AS (SELECT conv_id, roles, 0 AS i, 2 AS u, 1 AS a, CAST([] AS BIGINT[]) AS kept FROM l
    UNION ALL SELECT conv_id, roles, i + 1, CASE WHEN roles[i + 1] = 'user' AND u > 0 THEN u - 1 ELSE u END, CASE WHEN roles[i + 1] = 'assistant' AND a > 0 THEN a - 1 ELSE a END,
      CASE WHEN (roles[i + 1] = 'user' AND u > 0) OR (roles[i + 1] = 'assistant' AND a > 0) THEN list_append(kept, i) ELSE kept END FROM g WHERE i < len(roles))
    SELECT conv_id, array_to_string(kept, ',') AS kept FROM g WHERE i = len(roles)"""
)
def q_fewshot_quota(spark: SparkSession, d: str) -> DataFrame:
    """Items kept in order while their class has quota left: two user turns, one assistant turn."""
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("items"))
    start = F.expr("named_struct('u', 2, 'a', 1, 'i', 0, 'kept', CAST(array() AS array<int>))")

    def step(s, x):  # noqa: ANN001, ANN202
        user, other = (x["role"] == "user") & (s["u"] > 0), (x["role"] == "assistant") & (s["a"] > 0)
        kept = F.when(user | other, F.array_append(s["kept"], s["i"])).otherwise(s["kept"])
        return F.struct((s["u"] - user.cast("int")).alias("u"), (s["a"] - other.cast("int")).alias("a"), (s["i"] + 1).alias("i"), kept.alias("kept"))

    return lists.select("conv_id", F.array_join(F.aggregate("items", start, step)["kept"].cast("array<string>"), ",").alias("kept"))


@query(
    f"""WITH RECURSIVE {LINES}, l AS (SELECT l_orderkey, list(l_partkey % 100 ORDER BY k) AS p FROM v GROUP BY 1), g AS (SELECT l_orderkey, p, [p[1]] AS chosen, 1 AS n FROM l
    UNION ALL SELECT l_orderkey, p, list_append(chosen, (SELECT arg_max(u, (SELECT min(abs(u - c)) FROM unnest(chosen) s(c)) * 1000 - u) FROM unnest(p) t(u))), n + 1 FROM g WHERE n < 3)
    SELECT l_orderkey, array_to_string(chosen, ',') AS chosen FROM g WHERE n = 3"""
)
def q_fps(spark: SparkSession, d: str) -> DataFrame:
    """Farthest-point sampling of three points from the first, ties to the smaller value."""
    one = order_items(spark, d).select("l_orderkey", F.transform("items", lambda x: x["l_partkey"] % 100).alias("p")).withColumn("chosen", F.slice("p", 1, 1))
    for _ in range(2):
        far = F.array_max(F.transform("p", lambda u: F.struct((F.array_min(F.transform("chosen", lambda c: F.abs(u - c))) * 1000 - u).alias("g"), u.alias("u"))))
        one = one.withColumn("chosen", F.array_append("chosen", far["u"]))
    return one.select("l_orderkey", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"))


@query(
    f"""WITH RECURSIVE {LINES}, l AS (SELECT l_orderkey, list(l_partkey % 100 ORDER BY k) AS p, list(q ORDER BY k) AS s FROM v GROUP BY 1),
    g AS (SELECT l_orderkey, p, list_transform(s, lambda x: CAST(x AS DOUBLE)) AS s, CAST([] AS BIGINT[]) AS kept, 0 AS n FROM l
    UNION ALL SELECT l_orderkey, p, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = b THEN -1.0 ELSE s[i] * CASE WHEN abs(p[i] - p[b]) < 20 THEN 0.5 ELSE 1.0 END END), list_append(kept, b), n + 1
      FROM (SELECT *, (SELECT arg_max(i, s[i] * 1000 - i) FROM unnest(range(1, len(p) + 1)) t(i)) AS b FROM g WHERE n < 3 AND n < len(p)))
    SELECT l_orderkey, array_to_string(arg_max(kept, n), ',') AS kept FROM g GROUP BY l_orderkey"""
)
def q_soft_nms(spark: SparkSession, d: str) -> DataFrame:
    """Soft suppression: the best of what is left is taken three times, and halves the scores near it."""
    items = order_items(spark, d).select("l_orderkey", F.transform("items", lambda x, i: F.struct((x["l_partkey"] % 100).alias("p"), (-x["m"]).cast("double").alias("s"), (i + 1).alias("i"))).alias("items"))
    one = items.withColumn("kept", F.expr("CAST(array() AS array<int>)"))
    for _ in range(3):
        best = F.array_max(F.transform("items", lambda x: F.struct((x["s"] * 1000 - x["i"]).alias("g"), x["i"].alias("i"), x["p"].alias("p"))))
        one = one.withColumn("best", best)
        near = lambda x: F.when(F.abs(x["p"] - F.col("best.p")) < 20, 0.5).otherwise(1.0)
        left = F.transform(F.filter("items", lambda x: x["i"] != F.col("best.i")), lambda x: F.struct(x["p"].alias("p"), (x["s"] * near(x)).alias("s"), x["i"].alias("i")))
        one = one.withColumns({"kept": F.when(F.col("best").isNull(), F.col("kept")).otherwise(F.array_append("kept", F.col("best.i"))), "items": left}).drop("best")
    return one.select("l_orderkey", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("SELECT o_orderkey, CAST(tile AS BIGINT) AS tile, (seq - 1) % 4 AS slot FROM (SELECT o_orderkey, ntile(6) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS tile, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders)")
def q_ntile_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Balanced contiguous ranges of each owner's rows, and the same rows dealt round robin."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(6).over(w).cast(LONG).alias("tile"), ((F.row_number().over(w) - 1) % 4).cast(LONG).alias("slot"))


@query(
    """WITH RECURSIVE s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, c_nationkey) AS k FROM s),
    g AS (SELECT 0 AS k, [0, 0, 0, 0]::BIGINT[] AS bins, CAST(NULL AS INT) AS nation, 0 AS bin UNION ALL
    SELECT o.k, list_transform(range(1, 5), lambda i: bins[i] + CASE WHEN i = list_position(bins, list_min(bins)) THEN o.n ELSE 0 END), o.c_nationkey, list_position(bins, list_min(bins)) FROM g JOIN o ON o.k = g.k + 1)
    SELECT nation, CAST(bin AS BIGINT) AS bin FROM g WHERE k > 0"""
)
def q_bin_pack(spark: SparkSession, d: str) -> DataFrame:
    """Largest first into the emptiest of four bins; the items are the 25 nations, whatever the size of the data."""
    sizes = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    items = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c_nationkey"))).alias("items"))
    start = F.expr("named_struct('bins', array(0L, 0L, 0L, 0L), 'put', CAST(array() AS array<struct<nation:int,bin:bigint>>))")

    def step(s, x):  # noqa: ANN001, ANN202
        at = F.array_position(s["bins"], F.array_min(s["bins"]))
        bins = F.transform(s["bins"], lambda b, i: b - F.when(i + 1 == at, x["m"]).otherwise(0))
        return F.struct(bins.alias("bins"), F.array_append(s["put"], F.struct(x["c_nationkey"].alias("nation"), at.alias("bin"))).alias("put"))

    return items.select(F.inline(F.aggregate("items", start, step)["put"]))


@query(
    """SELECT user_id, event_id, best, CAST(sum(fresh) OVER w AS BIGINT) AS improvements, CAST(seq - max(CASE WHEN fresh = 1 THEN seq END) OVER w AS BIGINT) AS since FROM (
    SELECT *, min(value) OVER v AS best, CASE WHEN value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e308) THEN 1 ELSE 0 END AS fresh, row_number() OVER v AS seq FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def q_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    """The best value so far, how often it improved and how many rows ago."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, d, "events").withColumns({"best": F.min("value").over(so_far), "fresh": (before.isNull() | (F.col("value") < before)).cast("int"), "seq": F.row_number().over(w)})
    return rows.select("user_id", "event_id", "best", F.sum("fresh").over(so_far).alias("improvements"), (F.col("seq") - F.max(F.when(F.col("fresh") == 1, F.col("seq"))).over(so_far)).cast(LONG).alias("since"))

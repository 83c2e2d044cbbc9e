"""Text, JSON, intervals, bands, sampling and geometry on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import bucket, k_of_each
from ..operators.text import clean, clean_label, swap_whole_words, swap_words
from ..session import table
from .catalog import query

LONG = "bigint"


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(trim(text)), '_', ' '), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS digest, CAST(length(trim(regexp_replace(regexp_replace(replace(lower(trim(text)), '_', ' '), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS BIGINT) AS n FROM documents")
def q_text_clean(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("c"))
    return out.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast(LONG).alias("n"))


@query(
    """SELECT p_partkey, t.i AS template, replace(t.f, '{}', replace(replace(regexp_replace(p_name || '_(' || p_type || ')', '\\(.*\\)', '', 'g'), '_', ' '), '  ', ' ')) AS prompt, CAST(string_split(p_brand, '#')[-1] AS INT) AS brand
    FROM part, (VALUES (0, 'a photo of a {}'), (1, 'a {} in a scene'), (2, 'one {}')) t(i, f)"""
)
def q_label_template(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned labels put into each of three templates."""
    label = clean_label(F.concat("p_name", F.lit("_("), "p_type", F.lit(")")))
    forms = F.array(*map(F.lit, ("a photo of a {}", "a {} in a scene", "one {}")))
    rows = table(spark, d, "part").select("p_partkey", label.alias("label"), F.substring_index("p_brand", "#", -1).cast("int").alias("brand"), F.posexplode(forms).alias("template", "f"))
    return rows.select("p_partkey", "template", F.replace("f", F.lit("{}"), F.col("label")).alias("prompt"), "brand")


@query("SELECT conv_id, md5(string_agg(upper(role) || ': ' || text, ' </s> ' ORDER BY turn)) AS digest, CAST(sum(length(role) + 2 + length(text)) + 6 * (count(*) - 1) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def q_prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Turns joined in order into one prompt."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("t"))))
    out = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), " </s> ").alias("p"))
    return out.select("conv_id", F.md5("p").alias("digest"), F.length("p").cast(LONG).alias("n"))


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'the' THEN 'that' WHEN 'that' THEN 'the' WHEN 'of' THEN 'to' WHEN 'to' THEN 'of' ELSE w END), ' ') AS swapped FROM benchmark")
def q_word_swap(spark: SparkSession, d: str) -> DataFrame:
    """Words and their counterparts exchanged in one pass."""
    return table(spark, d, "benchmark").select("item_id", swap_words(F.col("text"), {"the": "that", "of": "to"}).alias("swapped"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) // 10 AS band, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type", F.floor(k / 10).cast("int").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://(?:www\.|m\.)?([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS BIGINT) AS number,
    regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page, CAST((360 - coalesce(CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS BIGINT), 0) % 360) % 360 AS BIGINT) AS flipped FROM pages"""
)
def q_url_parse(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a name encodes, by pattern; an angle flipped into 0 to 359."""
    number = F.nullif(F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1), F.lit("")).cast(LONG)
    rows = table(spark, d, "pages").select("page_id", "url", number.alias("number"))
    return rows.select(
        "page_id", F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), "number",
        F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"), F.pmod(360 - F.coalesce("number", F.lit(0)), F.lit(360)).alias("flipped"),
    )


@query(
    """WITH b AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations)
    SELECT x.conv_id, x.turn AS a, y.turn AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM b x JOIN b y ON x.conv_id = y.conv_id AND x.turn < y.turn WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.05"""
)
def q_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the turns of one conversation (a conversation has a few turns)."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", words.alias("w")))).alias("t"))
    pairs = turns.select("conv_id", "t", F.explode("t").alias("x")).select("conv_id", "x", F.explode(F.filter("t", lambda y: y["turn"] > F.col("x.turn"))).alias("y"))
    score = F.size(F.array_intersect("x.w", "y.w")) / F.size(F.array_union("x.w", "y.w"))
    return pairs.select("conv_id", F.col("x.turn").alias("a"), F.col("y.turn").alias("b"), score.alias("s")).where("s >= 0.05").select("conv_id", "a", "b", F.round("s", 6).alias("jaccard"))


@query(
    """SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS BIGINT) AS longest FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_shipdate BETWEEN o_orderdate - INTERVAL 400 DAY AND o_orderdate + INTERVAL 400 DAY GROUP BY 1"""
)
def q_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose date lies in the closed interval around their order's."""
    both = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    inside = both.where(F.col("l_shipdate").between(F.expr("o_orderdate - INTERVAL 400 DAYS"), F.expr("o_orderdate + INTERVAL 400 DAYS")))
    return inside.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max(F.expr("timestampdiff(DAY, o_orderdate, l_shipdate)")).cast(LONG).alias("longest"))


@query(
    """WITH b AS (SELECT p_brand, min(p_retailprice) AS lo, avg(p_retailprice) AS hi FROM part GROUP BY 1)
    SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_type) AS BIGINT) AS types FROM part JOIN b USING (p_brand) WHERE p_retailprice > lo AND p_retailprice < hi GROUP BY 1"""
)
def q_open_range(spark: SparkSession, d: str) -> DataFrame:
    """Values strictly inside their group's band."""
    part = table(spark, d, "part").select("p_brand", "p_type", "p_retailprice")
    bands = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.avg("p_retailprice").alias("hi"))
    return part.join(bands, "p_brand").where("p_retailprice > lo and p_retailprice < hi").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"))


@query("SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS band, l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def q_range_join_bins(spark: SparkSession, d: str) -> DataFrame:
    """Values put into bins by their edges: the edge itself belongs to the bin above."""
    edges = F.array(F.lit(10.0), F.lit(25.0), F.lit(40.0))
    band = F.size(F.filter(edges, lambda e: e <= F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy(band.alias("band"), "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    """WITH t AS (SELECT conv_id, turn, w, CAST(k AS BIGINT) AS k, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations))
    SELECT conv_id, turn, span, min(k) AS first_token, max(k) AS last_token FROM t JOIN (VALUES (0, 10, 24), (1, 40, 41), (2, 90, 140)) v(span, a, b) ON s <= b AND s + length(w) - 1 >= a WHERE length(w) > 0 GROUP BY ALL"""
)
def q_span_token_join(spark: SparkSession, d: str) -> DataFrame:
    """Character spans mapped to the tokens that they touch."""
    size = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, d, "conversations").select("conv_id", "turn", size.alias("sizes"))
    # running start of each token, within the row
    starts = F.aggregate("sizes", F.expr("named_struct('at', 0, 'out', CAST(array() AS array<int>))"), lambda s, n: F.struct((s["at"] + n + 1).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]
    spans = F.array(*[F.struct(F.lit(i).alias("span"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a, b in ((0, 10, 24), (1, 40, 41), (2, 90, 140))])
    tokens = rows.select("conv_id", "turn", "sizes", F.posexplode(starts).alias("k", "s")).withColumn("n", F.col("sizes")[F.col("k")]).where("n > 0")
    hit = tokens.select("conv_id", "turn", "k", F.explode(F.filter(spans, lambda v: (F.col("s") <= v["b"]) & (F.col("s") + F.col("n") - 1 >= v["a"]))).alias("v"))
    return hit.groupBy("conv_id", "turn", "v.span").agg(F.min("k").cast(LONG).alias("first_token"), F.max("k").cast(LONG).alias("last_token"))


HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(f"SELECT doc_id, CASE WHEN {HASH.format('CAST(doc_id AS VARCHAR)')} % 10 < 9 THEN 'train' ELSE 'val' END AS split FROM documents")
def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Nine to one by a hash of the id: the same however the rows are dealt."""
    return table(spark, d, "documents").select("doc_id", F.when(bucket(F.col("doc_id"), 10) < 9, "train").otherwise("val").alias("split"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('pick' || event_id), event_id) AS r FROM events) WHERE r <= 2")
def q_k_of_n(spark: SparkSession, d: str) -> DataFrame:
    return k_of_each(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], 2, "event_id", "pick").drop("pick")


@query("SELECT x, y, z, vec_id FROM (SELECT CAST(floor(embedding[1] * 4) AS INT) AS x, CAST(floor(embedding[2] * 4) AS INT) AS y, CAST(floor(embedding[3] * 4) AS INT) AS z, vec_id, row_number() OVER (PARTITION BY floor(embedding[1] * 4), floor(embedding[2] * 4), floor(embedding[3] * 4) ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r = 1")
def q_voxel_sample(spark: SparkSession, d: str) -> DataFrame:
    """One point of each grid cell, by hash."""
    cell = [F.floor(F.col("embedding")[i] * 4).cast("int").alias(c) for i, c in enumerate("xyz")]
    return k_of_each(table(spark, d, "embeddings").select(*cell, "vec_id"), ["x", "y", "z"], 1, "vec_id").select("x", "y", "z", "vec_id")


@query(
    """WITH u AS (SELECT p_brand, p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40))
    SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('neg' || p_partkey), p_partkey) AS r FROM u) WHERE r <= 7"""
)
def q_anti_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to seven negatives of each class: none of the positives, by hash."""
    positive = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return k_of_each(table(spark, d, "part").select("p_brand", "p_partkey").join(positive, "p_partkey", "left_anti"), ["p_brand"], 7, "p_partkey", "neg").select("p_brand", "p_partkey")


@query(
    """WITH s AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY source, toxic ORDER BY md5('bal' || doc_id), doc_id) AS r, source FROM labels JOIN documents USING (doc_id)) SELECT source, toxic, doc_id FROM s WHERE r <= CASE WHEN toxic = 1 THEN 3 ELSE 9 END"""
)
def q_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Positives and negatives of each group up to their caps."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "toxic", "doc_id")
    picked = k_of_each(rows, ["source", "toxic"], 9, "doc_id", "bal")
    return picked.where("toxic = 0 or pick <= 3").drop("pick")


@query("SELECT lang, CAST(sum((length(text) - length(replace(lower(text), 'no', ''))) // 2) AS BIGINT) AS n_no, round(avg(CASE WHEN lower(text) LIKE '%un%' THEN 1.0 ELSE 0 END), 6) AS with_un FROM documents GROUP BY lang")
def q_substring_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a substring, also inside other words."""
    low = F.lower("text")
    times = ((F.length("text") - F.length(F.replace(low, F.lit("no"), F.lit("")))) / 2).cast(LONG)
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(times).alias("n_no"), F.round(F.avg(low.contains("un").cast("double")), 6).alias("with_un"))


@query(
    """SELECT o_orderkey, CAST((o_orderkey * 37 - 400) % 360 + CASE WHEN (o_orderkey * 37 - 400) % 360 < 0 THEN 360 ELSE 0 END AS BIGINT) AS azimuth, round(degrees(acos(greatest(-1, least(1, cos(radians(o_orderkey * 37 % 360)) * cos(radians(o_custkey * 11 % 180 - 90)))))), 6) AS angle FROM orders"""
)
def q_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angles wrapped into 0 to 359, and the angle between two directions with its cosine clamped."""
    az, el = F.radians(F.col("o_orderkey") * 37 % 360), F.radians(F.col("o_custkey") * 11 % 180 - 90)
    inner = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(az) * F.cos(el)))
    return table(spark, d, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 37 - 400, F.lit(360)).alias("azimuth"), F.round(F.degrees(F.acos(inner)), 6).alias("angle"))


@query(
    """WITH e AS (SELECT l_orderkey AS mesh, least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, l_linenumber AS face FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50)
    SELECT mesh, a, b, CAST(count(DISTINCT face) AS BIGINT) AS n_faces, array_to_string(list_sort(list(DISTINCT face)), ',') AS faces FROM e GROUP BY ALL"""
)
def q_edge_faces(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges with the faces that meet at them."""
    v, w = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    edges = table(spark, d, "lineitem").where(v != w).select(F.col("l_orderkey").alias("mesh"), F.least(v, w).alias("a"), F.greatest(v, w).alias("b"), F.col("l_linenumber").alias("face"))
    return edges.groupBy("mesh", "a", "b").agg(F.array_sort(F.collect_set("face")).alias("f")).select("mesh", "a", "b", F.size("f").cast(LONG).alias("n_faces"), F.array_join(F.col("f").cast("array<string>"), ",").alias("faces"))


SWAPS = {"the": "that", "of": "to", "and": "in"}
CASED = {f(a): f(b) for k, v in SWAPS.items() for a, b in ((k, v), (v, k)) for f in (str.upper, str.capitalize, str)}


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM conversations), m AS (SELECT MAP {"""
    + ", ".join(f"'{k}': '{v}'" for k, v in CASED.items())
    + """} AS swap) SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: coalesce(swap[x], x)), '') AS swapped FROM t, m"""
)
def q_swap_whole_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole words of a text and their counterparts change places, in any of three cases, whatever stands between words."""
    return table(spark, d, "conversations").select("conv_id", "turn", swap_whole_words(F.col("text"), SWAPS).alias("swapped"))

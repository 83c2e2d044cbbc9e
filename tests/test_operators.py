"""Edge semantics of the operators on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from sparktally.operators.boxes import iou
from sparktally.operators.dedup import by_priority
from sparktally.operators.graph import connected_components
from sparktally.operators.numbering import numbered
from sparktally.operators.ranking import average_precision, precision_recall, score_levels
from sparktally.operators.text import clean, clean_label, swap_whole_words, swap_words
from sparktally.operators.vectors import exact_nearest
from sparktally.sources.logs import last_record, means_by_feature, read_allowlist, read_keyed_tsv, read_metrics, write_report
from sparktally.streaming.jobs import read_events, rolling_means, upsert_latest, windowed_counts


def test_priority_beats_order(spark):
    low = spark.createDataFrame([(1, 9, "low"), (2, 1, "low")], "k int, t int, v string")
    high = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, t int, v string")
    assert {(r.k, r.v) for r in by_priority([high, low], ["k"], [F.desc("t")]).collect()} == {(1, "new"), (2, "low")}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 20), (None, 5), (4, 3), (12, 11)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_average_precision(spark):
    rows = spark.createDataFrame([("a", 5, True), ("a", 4, False), ("a", 3, True), ("b", 1, False)], "c string, s int, hit boolean")
    curve = precision_recall(score_levels(rows, ["c"], "s", F.col("hit")), ["c"], "s")
    got = {r.c: r.ap for r in average_precision(curve, ["c"], "s").collect()}
    assert math.isclose(got["a"], 0.5 + 0.5 * 2 / 3) and got["b"] is None


def test_touching_and_empty_boxes(spark):
    rows = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (2.0, 0.0, 4.0, 2.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert [r[0] for r in rows.select(iou(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0]
    assert rows.select(iou(F.col("a"), F.col("b"), 1.0)).first()[0] == pytest.approx(3 / 15)


def test_text(spark):
    rows = spark.createDataFrame([("  Éa_b! ok ", "x (y (z))_w", "left to right left")], "a string, b string, c string")
    got = rows.select(clean(F.col("a")), clean_label(F.col("b")), swap_words(F.col("c"), {"left": "right"})).first()
    assert tuple(got) == ("éa b ok", "x  w".replace("  ", " "), "right to left right")


def test_exact_nearest_ties_and_blocks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<float>")
    for block in (1, 100):
        got = {(r.query_id, r.rank): r.vec_id for r in exact_nearest(rows, rows.where("vec_id in (1, 4)"), 2, block).collect()}
        assert got == {(1, 1): 2, (1, 2): 3, (4, 1): 1, (4, 2): 2}


def test_metric_logs(spark, tmp_path):
    row = "{'mesh_file': '/m/%s.obj', 'iou': %s, 'precision': 0.5, 'recall': 0.5, 'F1': 0.5, 'feature': '%s', 'feature_idx': %d}"
    (tmp_path / "a.log").write_text("\n".join([row % ("12", "0.1", "face", 1), "====", "Avg Metrics 3", "{'feature': broken", row % ("12", "0.3", "face", 1), row % ("12345678", "nan", "edge", 2)]))
    (tmp_path / "b.log").write_text(row % ("12345678", "0.9", "edge", 2))
    (tmp_path / "allow.txt").write_text("# comment\n\n12,face,1\n12345678,edge,2\n")
    found = last_record(read_metrics(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]))
    means = means_by_feature(found, read_allowlist(spark, str(tmp_path / "allow.txt")))
    assert {r.feature: (r.n, r.iou) for r in means.collect()} == {"face": (1, 0.3), "edge": (1, 0.9)}
    write_report(means, str(tmp_path / "out"))
    assert {r.iou for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"0.3000", "0.9000"}


def test_keyed_tsv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('k1\t{"n": 3}\taGk=\n')
    r = read_keyed_tsv(spark, str(tmp_path / "t.tsv"), "n int").first()
    assert (r.key, r.label.n, bytes(r.payload)) == ("k1", 3, b"hi")


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 4}:00:0{i}", i % 2, "view", float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("{}"))
    for n in range(2):
        df.where(F.col("event_id") % 2 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = windowed_counts(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from hours").first()[0] == 8
    q = rolling_means(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("rolling").start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: r.mean for r in spark.sql("select user_id, max_by(mean, events) as mean from rolling group by 1").collect()} == {0: 3.0, 1: 4.0}
    q = read_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(upsert_latest(str(tmp_path / "t"), ["user_id"], "ts")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "t" / "version=1"))
    assert {r.user_id: r.event_id for r in last.collect()} == {0: 6, 1: 7}


def test_numbers_of_sparse_and_crowded_keys(spark):
    rows = [(i * 10**15,) for i in range(300)] + [(7,)] * 500 + [(None,), (-(2**63),)]
    df = spark.createDataFrame(rows, "k long").repartition(5)
    got = [(r.k, r["index"]) for r in numbered(df, "k").collect()]
    assert sorted(i for _, i in got) == list(range(len(rows)))
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted((k for k, in rows), key=lambda k: (k is not None, k or 0))
    assert numbered(df.limit(0), "k").count() == 0


def test_swap_whole_words(spark):
    pairs = {"left": "right", "leftmost": "rightmost", "left-most": "right-most", "leftward": "rightward"}
    cases = {
        "the Left one, LEFT (right)!": "the Right one, RIGHT (left)!",
        "left-most left-hand leftmost; leftover _left left_": "right-most right-hand rightmost; leftover _left left_",
        "bright éleft left9 Leftward\trightward": "bright éleft left9 Rightward\tleftward",
        "": "",
        "no sides": "no sides",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "c string")
    got = {r.c: r.s for r in rows.select("c", swap_whole_words(F.col("c"), pairs).alias("s")).collect()}
    assert got == cases | {None: None}

"""Readers and writers on small files, the literal parser, exact neighbours and streaming top-n."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparktally.operators.vectors import exact_nearest
from sparktally.sources import files
from sparktally.sources.logs import last_record, means_by_feature, read_allowlist, read_metrics
from sparktally.streaming.jobs import read_events, running_top_n


def test_literals_and_real_names(spark, tmp_path):
    rows = [
        """{'mesh_file': '/m/00012345_mesh_a.obj', 'note': "it's None, True here", 'iou': 0.5, 'precision': nan, 'recall': 1e-1, 'F1': -inf, 'feature': ' face ', 'feature_idx': 1}""",
        """  {'cad_file': '77', 'note': 'say "nan": \\'inf\\', None', 'iou': None, 'precision': 1.0, 'recall': 1.0, 'F1': 1.0, 'feature': 'edge', 'feature_idx': 2, 'extra': True}""",
        """{'mesh_file': '/m/99_x.obj', 'feature': 'edge'""",
    ]
    (tmp_path / "a.log").write_text("\n".join(rows))
    found = last_record(read_metrics(spark, [str(tmp_path / "a.log")], "note string, extra boolean"))
    got = {r.cad_name: r for r in found.collect()}
    assert set(got) == {"00012345", "00000077"}
    a, b = got["00012345"], got["00000077"]
    assert (a.note, a.iou, a.precision, a.recall, a.F1, a.feature) == ("it's None, True here", 0.5, None, 0.1, None, "face")
    assert (b.note, b.iou, b.extra) == ("""say "nan": 'inf', None""", None, True)
    (tmp_path / "allow.txt").write_text("00012345,face,1\n77,edge,2\n")
    assert {r.feature: r.n for r in means_by_feature(found, read_allowlist(spark, str(tmp_path / "allow.txt"))).collect()} == {"face": 1, "edge": 1}


def test_composite_and_line_list(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k0\t{}\taGk=\nk1\t{}\taGk=\n")
    (tmp_path / "b.tsv").write_text("m0\t{}\taGk=\n")
    (tmp_path / "order").write_text("1\t0\n0\t1\n1\t0\n")
    rows = files.read_composite(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")], str(tmp_path / "order")).orderBy("seq").collect()
    assert [(r.seq, r.key, bytes(r.payload)) for r in rows] == [(0, "m0", b"hi"), (1, "k1", b"hi"), (2, "m0", b"hi")]
    base = spark.createDataFrame([(0, "a"), (1, "b")], "row int, v string")
    assert sorted(r.v for r in files.by_line_list(base, spark.createDataFrame([(1,), (1,), (0,)], "line int")).collect()) == ["a", "b", "b"]


def test_voc_xml_and_phrases(spark, tmp_path):
    obj = "<object><name> Dog </name><difficult>%d</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>10</xmax><ymax>20</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.jpg</filename><size><width>30</width><height>40</height></size>{obj % 0}{obj % 1}</annotation>")
    got = files.read_voc(spark, str(tmp_path / "a.xml")).collect()
    assert [tuple(r) for r in got] == [("a.jpg", 30, 40, "dog", False, 0, 1, 9, 19)]
    assert files.read_voc(spark, str(tmp_path / "a.xml"), keep_difficult=True).count() == 2
    lines = spark.createDataFrame([(0, "[/EN#12/people A man] with [/EN#3/other/scene two hats] on")], "line int, value string")
    assert [tuple(r) for r in files.read_phrases(lines).orderBy("phrase_no").collect()] == [(0, 0, "12", "people", "A man"), (0, 1, "3", "other/scene", "two hats")]


def test_labels_files_and_folders(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("arm\n\n leg \n")
    want = [(0, "arm"), (1, "leg")]
    assert [tuple(r) for r in files.label_list(spark, str(tmp_path / "labels.txt")).orderBy("idx").collect()] == want
    assert [tuple(r) for r in files.label_list(spark, "arm, leg").orderBy("idx").collect()] == want
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "x.npy").write_text("1")
    rows = spark.createDataFrame([("x",), ("y",)], "id string")
    assert [r.id for r in files.with_files(rows, spark, str(tmp_path / "side"), F.concat("id", F.lit(".npy"))).collect()] == ["x"]
    for cad in ("c1", "c2"):
        (tmp_path / cad).mkdir()
        for kind in ("edge", "face"):
            (tmp_path / cad / f"{kind}_captions.log").write_text("{'idx': 1, 'q': \"what's it\"}\nbroken\n{'idx': 2, 'q': None}\n")
    got = files.read_folder_logs(spark, [str(tmp_path / c) for c in ("c1", "c2")], "idx int, q string").collect()
    assert len(got) == 8 and {(r.feature, r.cad_name) for r in got} == {(f, c) for f in ("edge", "face") for c in ("c1", "c2")} and {r.q for r in got} == {"what's it", None}
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert tuple(files.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string").first()) == (1, "x")


def test_ply_round_trip(spark, tmp_path):
    data = [(i, i / 2, -i / 4, 1.0, i, 0, 255) for i in range(30)]
    files.write_ply(spark.createDataFrame(data, "i int, x double, y double, z double, r int, g int, b int").repartition(4), str(tmp_path / "cloud"))
    text = next((tmp_path / "cloud").glob("part-*.txt")).read_text()
    assert text.startswith("ply\nformat ascii 1.0\nelement vertex 30\nproperty float x\n")
    got = files.read_ply(spark, str(tmp_path / "cloud")).orderBy("i").collect()
    assert [(r.i, r.x, r.y, r.z) for r in got] == [d[:4] for d in data]


def test_reports(spark, tmp_path):
    means = spark.createDataFrame([("a", 0.5, 0.25), ("b", 0.75, None)], "run string, iou double, f1 double")
    got = {r.name: r.value for r in files.latex_rows(means, "run", ["iou", "f1"]).collect()}
    assert got == {"a": "a & 0.500 & \\textbf{0.250} \\\\", "b": "b & \\textbf{0.750} & -- \\\\"}
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "run string, path string")
    assert {r.value for r in files.manifest(rows, "run").collect()} == {"- **a**: 2 rows from 2 files", "- **b**: 1 rows from 1 files"}
    files.write_label_lists(rows, "run", "path", str(tmp_path / "lists"))
    assert {(r.dataset, r.value) for r in spark.read.text(str(tmp_path / "lists")).collect()} == {("a", "x"), ("a", "y"), ("b", "x")}


@pytest.mark.parametrize("rows", [(7, 11), (1000, 1000)])
def test_exact_nearest_by_force(spark, rows):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (60, 3)).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([*data, (100, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in exact_nearest(table, table.where("vec_id % 3 = 0"), 4, *rows).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q, v in data[::3]:
        if any(v):
            s = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in data if i != q and any(w)]
            want[q] = [i for _, i in sorted(s)[:4]]
    assert {q: [i for i, _ in v] for q, v in got.items()} == want


def test_nearest_by_bands_equals_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    customers = [(i, rng.randrange(4), round(rng.uniform(-300, 900), 1)) for i in range(300)]
    suppliers = [(i, rng.randrange(3), round(rng.uniform(-300, 900), 1)) for i in range(40)] + [(90, 1, 500.0), (91, 1, 500.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.c_custkey: r.s_suppkey for r in entry.QUERIES["q_best_match_thresholds"](spark, str(tmp_path)).collect()}
    want = {}
    for (c, n, a), (s, m, b) in itertools.product(customers, suppliers):
        if n == m:
            want[c] = min(want.get(c, (9e9, 0)), (abs(a - b), s))
    assert got == {c: s for c, (_, s) in want.items()}


def test_streaming_top_n(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", i % 2, "view" if i % 3 else "buy", float(i % 4)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit("{}"))
    for n in range(2):
        df.where(F.col("event_id") % 2 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = {}

    def sink(batch, number):
        for r in batch.collect():
            last.setdefault((number, r.event_type), {})[r.place] = r.event_id

    q = running_top_n(read_events(spark, str(tmp_path / "in")), 2).writeStream.outputMode("update").foreachBatch(sink).start()
    q.processAllAvailable()
    q.stop()
    assert last[(1, "view")] == {1: 7, 2: 2} and last[(1, "buy")] == {1: 3, 2: 6}

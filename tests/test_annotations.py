import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from sparktally.sources import annotations as ann
from sparktally.sources.annotations import clip, flatten_refs, image_size, in_split, read_database, rle_area, valid_boxes


def test_database(spark, tmp_path):
    data = {
        "images": [{"id": 1, "file_name": "a.jpg", "height": 10, "width": 20}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}, {"id": 6, "image_id": 1, "category_id": 2, "bbox": [1, 2, 1, 4], "area": 4, "iscrowd": 0}, {"id": 7, "image_id": 1, "category_id": 2, "bbox": [], "area": 0, "iscrowd": 0}],
        "categories": [{"id": 2, "name": "cup", "frequency": "r"}],
    }
    (tmp_path / "d.json").write_text(json.dumps(data))
    db = read_database(spark, str(tmp_path / "d.json"))
    good = valid_boxes(db["annotations"])
    assert [r.id for r in good.collect()] == [5] and db["categories"].first().frequency == "r"
    assert tuple(good.select(clip(F.col("box"), F.lit(3), F.lit(20)).alias("c")).first().c) == (1.0, 2.0, 3.0, 6.0)
    assert good.select(clip(F.col("box"), F.lit(1), F.lit(20)).alias("c")).first().c is None
    refs = spark.createDataFrame([(1, 1, "testA", [5, 99], [(1, "one"), (2, "two")]), (2, 1, "val", [-1], [(3, "none")]), (3, 8, "val", [5], [(4, "x")])], "ref_id long, image_id long, split string, ann_ids array<long>, sentences array<struct<sent_id:long,sent:string>>")
    rows = {r.sent_id: r for r in flatten_refs(refs, db["annotations"], db["images"]).collect()}
    assert set(rows) == {1, 2, 3} and len(rows[1].targets) == 1 and rows[3].targets is None and rows[3].no_target
    assert {r.ref_id for r in refs.where(in_split(F.col("split"), "test")).collect()} == {1} == {r.ref_id for r in refs.where(in_split(F.col("split"), "testA")).collect()}


def test_sizes_and_runs(spark):
    rows = spark.createDataFrame([('[{"height": 3, "width": 4}]', [2, 3, 1, 4]), ('{"height": 5, "width": 6}', [7]), ("7 8", [])], "v string, c array<int>")
    got = rows.select(image_size(F.col("v")).alias("s"), rle_area(F.col("c")).alias("n")).collect()
    assert [tuple(r.s) for r in got] == [(3, 4), (5, 6), (7, 8)] and [r.n for r in got] == [7, 0, 0]


class Indexes:
    """The database as dictionaries in memory."""

    def __init__(self, refs, data):
        anns, images, names = ({x["id"]: x for x in data[k]} for k in ("annotations", "images", "categories"))
        self.sents = {s["sent_id"]: (s["sent"], s["tokens"], r["ref_id"], r["split"], r["image_id"], images.get(r["image_id"], {}).get("file_name"), r["ann_id"], anns.get(r["ann_id"], {}).get("bbox"), names.get(r["category_id"], {}).get("name")) for r in refs for s in r["sentences"]}
        self.by = {}
        for r in refs:
            for owner in ("image_id", "category_id"):
                self.by.setdefault(owner, {}).setdefault(r[owner], []).append(r["ref_id"])


def test_referring_database(spark, tmp_path):
    sentence = lambda i, text: {"sent_id": i, "raw": text.upper(), "sent": text, "tokens": text.split()}
    refs = [{"ref_id": i, "ann_id": 100 + i % 5, "category_id": i % 3, "image_id": i % 4, "split": ["train", "val", "testA"][i % 3], "sentences": [sentence(10 * i + k, f"the thing é {k}") for k in range(i % 4)]} for i in range(2500)]
    data = {"images": [{"id": i, "file_name": f"{i}.jpg", "height": 5, "width": 6} for i in range(3)], "annotations": [{"id": 100 + i, "image_id": i, "category_id": 1, "bbox": [1.0, 2.0, 3.0, i], "area": 2.0, "iscrowd": 0} for i in range(4)], "categories": [{"id": i, "name": f"c{i}", "frequency": "r"} for i in range(2)]}
    (tmp_path / "refs(unc).p").write_bytes(pickle.dumps(refs, protocol=2))
    (tmp_path / "instances.json").write_text(json.dumps(data))
    db, table = read_database(spark, str(tmp_path / "instances.json")), ann.read_refs(spark, str(tmp_path / "refs(unc).p"))
    want = Indexes(refs, data)
    got = {r.sent_id: (r.sent, r.tokens, r.ref_id, r.split, r.image_id, r.file_name, r.ann_id, r.bbox, r.category) for r in ann.refer_records(table, db).collect()}
    assert got == want.sents
    for owner, ids in want.by.items():
        assert {r[owner]: r.ids for r in ann.members(table, owner, "ref_id").collect()} == ids
    (tmp_path / "bad.p").write_bytes(pickle.dumps(os.path.join))
    with pytest.raises(Exception, match="plain data"):
        ann.read_refs(spark, str(tmp_path / "bad.p")).count()


def test_phrases_with_boxes(spark, tmp_path):
    box = lambda names, inner: "<object>" + "".join(f"<name>{n}</name>" for n in names) + inner + "</object>"
    corners = "<bndbox><xmin>{}</xmin><ymin>2</ymin><xmax>{}</xmax><ymax>9</ymax></bndbox>"
    (tmp_path / "7.xml").write_text("<annotation>" + box(["11", "12"], corners.format(1, 5)) + box(["11"], corners.format(3, 8)) + box(["13"], "<nobndbox>1</nobndbox>") + "</annotation>")
    (tmp_path / "8.xml").write_text("<annotation>" + box(["13"], corners.format(4, 6)) + "</annotation>")
    boxes = ann.read_phrase_boxes(spark, str(tmp_path))
    assert {tuple(r) for r in boxes.collect()} == {("7", "11", 0, 1, 4, 8), ("7", "12", 0, 1, 4, 8), ("7", "11", 2, 1, 7, 8), ("8", "13", 3, 1, 5, 8)}
    assert {tuple(r) for r in ann.merged_boxes(boxes).where("phrase = '11'").collect()} == {("7", "11", 0, 1, 7, 8)}
    rows = [("7", 0, 0, "12", "a man"), ("7", 0, 1, "13", "the sky"), ("7", 0, 2, "11", "hats"), ("7", 0, 3, "12", "him"), ("7", 1, 0, "13", "it"), ("7", 2, None, None, None), ("8", 0, 0, "13", "the sky"), ("9", 0, 0, "11", "x")]
    got = ann.phrases_with_boxes(spark.createDataFrame(rows, "image string, sentence int, place int, phrase string, text string"), boxes).collect()
    assert {(r.image, r.sentence): r.phrases and [p.text for p in r.phrases] for r in got} == {("7", 0): ["a man", "hats", "him"], ("7", 1): None, ("7", 2): None, ("8", 0): ["the sky"], ("9", 0): None}

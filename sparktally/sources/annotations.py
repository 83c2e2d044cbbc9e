"""Annotation databases: images, boxes, categories and referring expressions as joined tables."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATABASE = """images array<struct<id:long,file_name:string,height:int,width:int>>,
annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>,
categories array<struct<id:long,name:string,frequency:string>>"""


def read_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three relations of an annotation file, one row for each element."""
    whole = spark.read.option("multiLine", True).schema(DATABASE).json(path)
    return {name: whole.select(F.inline(name)) for name in ("images", "annotations", "categories")}


def valid_boxes(annotations: DataFrame, least_side: float = 1.0) -> DataFrame:
    """Annotations with a box of which no side is ``least_side`` or less, as corners too (x1, y1, x2, y2)."""
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    rows = annotations.where((F.size("bbox") == 4) & (w > least_side) & (h > least_side))
    return rows.withColumn("box", F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")))


def clip(box: Column, width: Column, height: Column) -> Column:
    """The box within its image; null if nothing of it is left."""
    x1, x2 = F.greatest(box["x1"], F.lit(0.0)), F.least(box["x2"], width.cast("double"))
    y1, y2 = F.greatest(box["y1"], F.lit(0.0)), F.least(box["y2"], height.cast("double"))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def flatten_refs(refs: DataFrame, annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One row for each sentence of each reference, with its image and its annotations.

    refs: ref_id, image_id, split, ann_ids array<long>, sentences array<struct<sent_id,sent>>. The id -1 means that the
    sentence names nothing: such a row has no annotations and ``no_target`` true. Annotations that don't exist are left out.
    """
    named = refs.select("ref_id", F.explode_outer("ann_ids").alias("ann_id")).join(annotations.select(F.col("id").alias("ann_id"), "bbox", "area"), "ann_id")
    targets = named.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "bbox", "area"))).alias("targets"))
    rows = refs.join(targets, "ref_id", "left").join(images.select(F.col("id").alias("image_id"), "file_name", "height", "width"), "image_id")
    sentence = F.explode("sentences").alias("s")
    return rows.select("ref_id", "image_id", "file_name", "height", "width", "split", F.array_contains("ann_ids", F.lit(-1).cast("long")).alias("no_target"), "targets", sentence).select("*", "s.sent_id", "s.sent").drop("s")


def in_split(split: Column, wanted: str) -> Column:
    """``test`` matches any split that contains it; ``testA`` and its like match by the last letter; others by name."""
    if wanted == "test":
        return split.contains("test")
    if len(wanted) == 5 and wanted.startswith("test"):
        return split.contains(wanted[-1])
    return split == wanted


def image_size(label: Column) -> Column:
    """Height and width from a JSON list of dicts, a JSON dict, or two numbers."""
    kind = "height int, width int"
    plain = F.split(F.trim(label), r"\s+")
    two = F.when(F.regexp_like(label, F.lit(r"^\s*\d+\s+\d+\s*$")), F.struct(plain[0].cast("int").alias("height"), plain[1].cast("int").alias("width")))
    one = F.when(F.trim(label).startswith("{"), F.from_json(label, kind))
    many = F.when(F.trim(label).startswith("["), F.from_json(label, f"array<struct<{kind.replace(' int', ':int')}>>")[0])
    return F.coalesce(many, one, two)


def rle_area(counts: Column) -> Column:
    """Pixels of a column-major run-length mask: every second count, from the second."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


# ------------------------------------------------------------------------------------------------- a referring database

REFS = "ref_id long, ann_id long, category_id long, image_id long, split string, sentences array<struct<sent_id:long,raw:string,sent:string,tokens:array<string>>>"


class PlainUnpickler(pickle.Unpickler):
    """Reads containers, numbers and texts; a pickle that names anything else is refused, so that it can't run code."""

    def find_class(self, module: str, name: str) -> object:
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """The references of pickled lists of dicts, one row each, as in REFS. A pickle can't be split: each file is a task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                refs = PlainUnpickler(io.BytesIO(content), encoding="utf-8").load()
                for a in range(0, len(refs), 1000):
                    yield pd.DataFrame({"value": [json.dumps(r) for r in refs[a : a + 1000]]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
    return rows.select(F.from_json("value", REFS).alias("r")).select("r.*")


def refer_records(refs: DataFrame, database: dict[str, DataFrame]) -> DataFrame:
    """One row for each sentence with its reference, annotation, image and category: what each id of the database leads to.

    (sent_id, sent, tokens, ref_id, split, image_id, file_name, height, width, ann_id, bbox, area, category_id, category). What
    doesn't exist is null; references without sentences give no row.
    """
    anns = database["annotations"].select(F.col("id").alias("ann_id"), "bbox", "area")
    images = database["images"].select(F.col("id").alias("image_id"), "file_name", "height", "width")
    names = database["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    rows = refs.join(anns, "ann_id", "left").join(images, "image_id", "left").join(names, "category_id", "left")
    one = rows.select("*", F.explode("sentences").alias("s"))
    return one.select("s.sent_id", "s.sent", "s.tokens", "ref_id", "split", "image_id", "file_name", "height", "width", "ann_id", "bbox", "area", "category_id", "category")


def members(rows: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, ids): the ids that belong to each owner, in order: the references of an image or category, the annotations of an image."""
    return rows.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_list(member)).alias("ids"))


# ------------------------------------------------------------------------------------------------- phrases and their boxes

_PHRASE_BOXES = "object array<struct<name:array<string>,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,nobndbox:int,scene:int>>"


def read_phrase_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, phrase, x1, y1, x2, y2) of annotation files named by image; a box may belong to several phrases. Corners count from 0."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(_PHRASE_BOXES).load(path)
    image = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1).alias("image")
    one = rows.select(image, F.explode("object").alias("o")).where("o.bndbox is not null")
    corner = [(F.col(f"o.bndbox.{a}") - 1).alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    return one.select("image", F.explode("o.name").alias("phrase"), *corner)


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """The hull of each phrase's boxes in an image."""
    return boxes.groupBy("image", "phrase").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def phrases_with_boxes(phrases: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, sentence, phrases): of each sentence the phrases that have a box in its image, in order; null where none has.

    phrases: image, sentence, place, phrase, text; a sentence without phrases is a row with a null phrase. boxes: image, phrase.
    """
    there = boxes.select("image", "phrase").where("phrase is not null").distinct().withColumn("there", F.lit(True))
    rows = phrases.join(there, ["image", "phrase"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("place", "phrase", "text"))))
    return rows.groupBy("image", "sentence").agg(kept.alias("phrases")).withColumn("phrases", F.when(F.size("phrases") > 0, F.col("phrases")))

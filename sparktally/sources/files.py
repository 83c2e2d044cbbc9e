"""More readers and writers: composite key tables, detection XML, label lists, folder logs, point clouds, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import QUOTES, literal_to_json


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, in the schema given; nothing is inferred."""
    return spark.read.option("header", True).schema(schema).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, from 0; the file is one split for its numbers to be those of the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines.where("value <> ''")


def read_composite(spark: SparkSession, sources: list[str], order: str) -> DataFrame:
    """(seq, source, row, key, label, payload) in the order of a file of lines ``source<TAB>row``; a line may occur twice."""
    rows = None
    for n, path in enumerate(sources):
        one = numbered_lines(spark, path).select(F.lit(n).alias("source"), F.col("line").alias("row"), F.split("value", "\t").alias("c"))
        rows = one if rows is None else rows.unionByName(one)
    wanted = numbered_lines(spark, order).select(F.col("line").alias("seq"), F.split("value", "\t").alias("w"))
    wanted = wanted.select("seq", F.col("w")[0].cast("int").alias("source"), F.col("w")[1].cast("int").alias("row"))
    return wanted.join(rows, ["source", "row"]).select("seq", "source", "row", F.col("c")[0].alias("key"), F.get("c", F.lit(1)).alias("label"), F.unbase64(F.get("c", F.lit(2))).alias("payload"))


def by_line_list(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows whose ``row`` a list of line numbers (line) names, as often as it names them."""
    return rows.join(lines.select(F.col("line").alias("row")), "row")


VOC = "annotation"
_VOC_SCHEMA = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"


def read_voc(spark: SparkSession, path: str, keep_difficult: bool = False) -> DataFrame:
    """(filename, width, height, label, difficult, x1, y1, x2, y2) of each object; boxes from 0, names lower and trimmed."""
    rows = spark.read.format("xml").option("rowTag", VOC).schema(_VOC_SCHEMA).load(path)
    one = rows.select("filename", "size.width", "size.height", F.explode("object").alias("o"))
    box = [(F.col(f"o.bndbox.{a}") - 1).alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))]
    out = one.select("filename", "width", "height", F.trim(F.lower("o.name")).alias("label"), (F.coalesce("o.difficult", F.lit(0)) == 1).alias("difficult"), *box)
    return out if keep_difficult else out.where("not difficult")


def read_phrases(lines: DataFrame) -> DataFrame:
    """(line, phrase_no, entity, kind, phrase) from sentences with marked phrases ``[/EN#12/people A man]`` in ``value``."""
    marks = F.regexp_extract_all("value", F.lit(r"\[/EN#\d+(?:/[\w]+)+ [^\]]+\]"), F.lit(0))
    one = lines.select("line", F.posexplode(marks).alias("phrase_no", "m"))
    part = lambda g: F.regexp_extract("m", r"\[/EN#(\d+)/(\S+) ([^\]]+)\]", g)
    return one.select("line", "phrase_no", part(1).alias("entity"), part(2).alias("kind"), part(3).alias("phrase"))


def label_list(spark: SparkSession, names: str) -> DataFrame:
    """(idx, label) from a text file of labels, one a line, or from a comma-separated string; blanks are skipped."""
    if "/" in names or names.endswith(".txt"):
        rows = numbered_lines(spark, names).select("line", F.trim("value").alias("label"))
    else:
        rows = spark.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("line", "v")).select("line", F.trim("v").alias("label"))
    rows = rows.where("label <> ''").groupBy().agg(F.array_sort(F.collect_list(F.struct("line", "label"))).alias("l"))
    return rows.select(F.posexplode("l.label").alias("idx", "label"))


def with_files(rows: DataFrame, spark: SparkSession, folder: str, name: Column) -> DataFrame:
    """The rows whose file ``name`` exists in ``folder``; only names are listed, no content is read."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", "/", -1).alias("_file"))
    return rows.withColumn("_file", name).join(there, "_file", "left_semi").drop("_file")


def read_folder_logs(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """(feature, cad_name, line_no, record columns) of each folder's edge log, then its face log; broken lines are skipped."""
    lines = spark.read.text([f"{x}/{kind}_captions.log" for x in folders for kind in ("edge", "face")]).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"))
    rows = lines.where(F.trim("value").startswith("{")).withColumn("r", F.from_json(literal_to_json(F.trim("value")), schema, QUOTES)).where("r is not null")
    feature, cad = F.regexp_extract("path", r"([a-z]+)_captions\.log$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return rows.select(feature.alias("feature"), cad.alias("cad_name"), "line_no", "r.*")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, x, y, z) of the vertices of ASCII point clouds; what follows the vertices is left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.split(F.substring_index("value", "end_header\n", -1), "\n")
    n = F.regexp_extract("value", r"element vertex (\d+)", 1).cast("int")
    rows = files.select("path", n.alias("n"), F.posexplode(body).alias("i", "line")).where("i < n").select("path", "i", F.split(F.trim("line"), r"\s+").alias("v"))
    return rows.select("path", "i", *[F.col("v")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def ply_lines(points: DataFrame) -> DataFrame:
    """(value): an ASCII point cloud of (i, x, y, z, r, g, b), header first; ordered by ``i`` when written in one file."""
    head = points.agg(F.count("*").alias("n")).select(
        F.explode(F.array(*[F.lit(x) for x in ("ply", "format ascii 1.0")], F.concat(F.lit("element vertex "), F.col("n")), *[F.lit(f"property {'float' if c in 'xyz' else 'uchar'} {name}") for c, name in zip("xyzrgb", ("x", "y", "z", "red", "green", "blue"))], F.lit("end_header"))).alias("value"), F.lit(-1).alias("i")
    )
    rows = points.select(F.format_string("%f %f %f %d %d %d", "x", "y", "z", "r", "g", "b").alias("value"), F.col("i").cast("int").alias("i"))
    return head.unionByName(rows)


def write_ply(points: DataFrame, path: str) -> None:
    """One cloud is one file, as its readers expect; the header has a fixed order before the points."""
    lines = ply_lines(points)
    numbered = lines.withColumn("k", F.when(F.col("i") < 0, F.monotonically_increasing_id() - (1 << 62)).otherwise(F.col("i")))
    numbered.repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def latex_rows(means: DataFrame, name: str, metrics: list[str], digits: int = 3) -> DataFrame:
    """(name, value): a table row for each line of a report, the best of each column in bold within a tolerance of 1e-9."""
    best = means.agg(*[F.max(m).alias(f"_{m}") for m in metrics])  # one row
    shown = lambda m: F.format_string(f"%.{digits}f", F.col(m))
    cell = lambda m: F.when(F.col(m).isNull(), "--").when(F.abs(F.col(m) - F.col(f"_{m}")) <= 1e-9, F.concat(F.lit("\\textbf{"), shown(m), F.lit("}"))).otherwise(shown(m))
    return means.join(F.broadcast(best)).select(F.col(name).alias("name"), F.concat(F.concat_ws(" & ", F.col(name), *[cell(m) for m in metrics]), F.lit(" \\\\")).alias("value"))


def manifest(rows: DataFrame, group: str, path: str = "path") -> DataFrame:
    """(value): a Markdown line for each group with the number of its rows and of the files they come from."""
    one = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(path).alias("files"))
    return one.select(F.format_string("- **%s**: %d rows from %d files", F.col(group), "n", "files").alias("value"))


def write_label_lists(rows: DataFrame, dataset: str, label: str, path: str) -> None:
    """A text file of the different labels for each dataset, in a folder of its name."""
    rows.select(F.col(dataset).alias("dataset"), F.col(label).alias("value")).distinct().repartition("dataset").sortWithinPartitions("dataset", "value").write.mode("overwrite").partitionBy("dataset").text(path)

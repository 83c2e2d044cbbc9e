"""Readers and writers of evaluation logs: literal records, allowlists, folder lists, key tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a metric record; the optional ones are null where a writer leaves them out.
METRIC = "mesh_file string, cad_file string, iou double, precision double, recall double, F1 double, feature string, feature_idx int, inference_time double, peak_vram_mb double, num_views int"


#: A quoted string, with escapes.
_STRING = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
#: Words of Python literals outside of strings, and what JSON has for them.
WORDS = {"None": "null", "True": "true", "False": "false", "nan": "null", "-inf": "null", "inf": "null"}


def literal_to_json(line: Column) -> Column:
    """A dict printed by Python as JSON for from_json(allowSingleQuotes): None, True, False, nan and inf are replaced
    where they stand outside of strings; quotes stay as they are.
    """
    for word, instead in WORDS.items():
        first, rest = word[0], word[1:]
        # each match begins where the one before ended and passes over whole strings
        line = F.regexp_replace(line, rf"\G((?:[^'\"{first}]|{first}(?!{rest}\b)|{_STRING})*+){word}\b", f"$1{instead}")
    return line


def read_metrics(spark: SparkSession, paths: list[str], more: str = "") -> DataFrame:
    """(METRIC columns, pattern_no, path, line_no) of each record in ``paths`` (globs, in their order of trust).

    more: further columns that a writer adds, as ``name type, ...``.

    Lines that don't begin with a brace or don't name a feature (footers, averages) are skipped before parsing, and so
    are records that don't parse. pattern_no, path and line_no give the scan order, which decides between duplicates.
    """
    out = None
    for n, path in enumerate(paths):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.lit(n).alias("pattern_no"))
        out = lines if out is None else out.unionByName(lines)
    kept = out.where(F.ltrim("value").startswith("{") & F.col("value").contains("'feature'"))
    rows = kept.withColumn("r", F.from_json(literal_to_json(F.trim("value")), f"{METRIC}, {more}" if more else METRIC, QUOTES))
    rows = rows.withColumn("r", F.col("r").withField("feature", F.trim("r.feature")))
    return rows.where("r.feature is not null and r.feature_idx is not null").select("r.*", "pattern_no", "path", "line_no")


QUOTES = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def padded(name: Column) -> Column:
    """A name with zeros in front, up to eight characters."""
    return F.when(F.length(name) < 8, F.lpad(name, 8, "0")).otherwise(name)


def entity_key(mesh_file: Column) -> Column:
    """The base name of a mesh file up to its first underscore, without an extension, padded."""
    return padded(F.regexp_replace(F.substring_index(F.substring_index(mesh_file, "/", -1), "_", 1), r"\.[^.]*$", ""))


def last_record(rows: DataFrame) -> DataFrame:
    """One record of each entity: the last in scan order."""
    keyed = rows.withColumn("cad_name", F.coalesce(entity_key(F.col("mesh_file")), padded(F.col("cad_file"))))
    w = Window.partitionBy("cad_name", "feature", "feature_idx").orderBy(F.desc("pattern_no"), F.desc("path"), F.desc("line_no"))
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pattern_no", "path", "line_no")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(cad_name, feature, feature_idx) from lines ``name,feature,index``; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    part = F.split("v", ",")
    return lines.select(padded(F.trim(part[0])).alias("cad_name"), F.trim(part[1]).alias("feature"), F.trim(part[2]).cast("int").alias("feature_idx"))


def means_by_feature(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Mean metrics of the allowed entities by feature; a feature without any gives no row."""
    return rows.join(allowed, ["cad_name", "feature", "feature_idx"], "left_semi").groupBy("feature").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("iou", "precision", "recall", "F1")])


def read_keyed_tsv(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(key, label, payload) of a table of key, JSON label and base64 payload; ``label`` is the label's schema."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("key string, label string, payload string").csv(path)
    return rows.select("key", F.from_json("label", label).alias("label") if label else F.col("label"), F.unbase64("payload").alias("payload"))


def write_report(means: DataFrame, path: str, digits: int = 4) -> None:
    """A CSV with a header and numbers at fixed decimals."""
    cols = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in means.dtypes]
    means.select(*cols).write.mode("overwrite").option("header", True).csv(path)

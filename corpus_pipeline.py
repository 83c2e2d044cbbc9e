"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``.

Rows with a null id, rows that share an id and repeated rows are rows like any other; near_dedup keeps one of equal rows.
Null and empty texts go in the first stage. Texts of any length pass whole, but for the one copy of each source whose last
words the mix doesn't take. Further columns pass through all stages, whatever their names; those named like one that run()
or the last stage adds give way to it there. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktally.llm.common import table, written
from sparktally.llm.decontaminate import drop_contaminated
from sparktally.llm.langid import identified, keep_known
from sparktally.llm.mixing import mix
from sparktally.llm.sharding import shard
from sparktally.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op1's model reads every text. Those it calls ``und``, without letters, go; a null lang is filled in; mixtures stay."""
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, each by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target says; a source's last copy keeps only the words still wanted."""
    return mix(docs).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 24 and their slot in it."""
    return shard(docs)


#: In order; each reads what the one before has written.
STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixed), ("sharding", sharded)]

#: Fingerprints, alignments and the trained model have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; lang_pred and lang_score, what the first one's model finds in each whole text, stay with its rows."""
    docs = written(identified(table(spark, sf_dir, "documents")), STAGES[0][0])
    for name, stage in STAGES[1:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

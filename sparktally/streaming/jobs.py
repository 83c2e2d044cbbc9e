"""Structured Streaming forms of the log operators: windows, latest record by key, running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import keep_first

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of events in a folder, as a stream with event time ``at``."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by type and hour; a window closes when the watermark passes it."""
    return events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each id, as shards repeat them."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_latest(path: str, keys: list[str], *order: str):  # noqa: ANN201
    """A foreachBatch sink that keeps the latest row of each key in versions of a table under ``path``.

    A batch that is run again writes its own version anew from the version before it, so that nothing counts twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.withColumn("_batch", F.lit(number))
        if number > 0:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{path}/version={number - 1}"))
        keep_first(now, keys, *[F.desc(c) for c in order], F.desc("_batch")).write.mode("overwrite").parquet(f"{path}/version={number}")

    return sink


def rolling_means(events: DataFrame, n: int = 20) -> DataFrame:
    """(user_id, events, mean): each user's number of events and the mean of the last ``n`` values, as of each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, [])
        rows = pd.concat(batches).sort_values(["at", "event_id"])
        last = [*last, *rows["value"].tolist()][-n:]
        state.update((seen + len(rows), last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [seen + len(rows)], "mean": [sum(last) / len(last)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, events long, mean double", "events long, last array<double>", "update", GroupStateTimeout.NoTimeout)


def running_top_n(events: DataFrame, n: int = 10) -> DataFrame:
    """(event_type, place, event_id, value): each type's n best values so far, as of each batch; ties go to the smaller id.

    The state of a type is n pairs, however many events it has.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, ids = state.get if state.exists else ([], [])
        best = [(-v, i) for v, i in zip(values, ids, strict=True)]
        for rows in batches:
            best = sorted([*best, *zip((-rows["value"]).tolist(), rows["event_id"].tolist(), strict=True)])[:n]
        state.update(([-v for v, _ in best], [i for _, i in best]))
        yield pd.DataFrame({"event_type": key[0], "place": range(1, len(best) + 1), "event_id": [i for _, i in best], "value": [-v for v, _ in best]})

    schema = "event_type string, place int, event_id long, value double"
    return events.groupBy("event_type").applyInPandasWithState(step, schema, "vals array<double>, ids array<long>", "update", GroupStateTimeout.NoTimeout)

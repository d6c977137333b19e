"""The same semantics on streams: change feeds, vitals, beacons without repeats, failure counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def vitals(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """hour, kind, n, mean by event time; rows later than the watermark are left out of closed windows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return found.select(F.col("w.start").alias("hour"), F.col("event_type").alias("kind"), "n", "mean")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def failure_counts(events: DataFrame, limit: int = 3) -> DataFrame:
    """series, streak, deactivated after each batch: failures in a row, reset by a success; a series stays deactivated."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, off = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == "error" else 0
            off = off or streak >= limit
        state.update((streak, off))
        yield pd.DataFrame({"series": [key[0]], "streak": [streak], "deactivated": [off]})

    return events.groupBy("user_id").applyInPandasWithState(update, "series long, streak long, deactivated boolean", "streak long, off boolean", "update", GroupStateTimeout.NoTimeout)


def apply_changes(batch: DataFrame, path: str, spark: SparkSession, version: int) -> str:
    """Merges one batch of a change feed into the last snapshot under the path, as a new version; returns the version's folder.

    For foreachBatch: a version that is written already is left as it is, so that a batch that runs again changes nothing.
    """
    from townkit.operators.feeds import current_items

    target, last = f"{path}/v{version}", f"{path}/v{version - 1}"
    changes = batch.select(F.col("user_id").alias("series"), F.get_json_object("props", "$.k").cast("int").alias("item"), "event_id", "event_type", "value")
    deleted = F.col("event_type") == "error"
    newest = changes.groupBy("item").agg(F.max_by(F.struct("event_id", "event_type", "value", "series"), "event_id").alias("r")).select("item", "r.*")
    if version > 0:
        newest = spark.read.parquet(last).join(newest.select("item"), "item", "left_anti").unionByName(newest)
    current_items(newest, "item", "event_id", deleted).write.mode("ignore").parquet(target)
    return target

"""Change feeds as batches: the current state of items and of the series that they belong to, runs and their accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.operators.numbering import numbered_in_groups


def current_items(changes: DataFrame, item: str, seq: str, deleted: Column) -> DataFrame:
    """The last change of each item, without items whose last change deletes them: an aggregate, one row of an item a task."""
    others = [c for c in changes.columns if c != item]
    last = changes.withColumn("_gone", F.coalesce(deleted, F.lit(False))).groupBy(item).agg(F.max_by(F.struct("_gone", *others), F.col(seq)).alias("_r"))
    return last.where(~F.col("_r._gone")).select(item, *(F.col(f"_r.{c}").alias(c) for c in others))


def series_state(changes: DataFrame, item: str, series: str, seq: str, deleted: Column) -> DataFrame:
    """series, items, last_seq, and the row of the last update of each series that a live item maps to.

    The row can come from an item that has moved or gone since: a series lives as long as one item maps to it.
    """
    live = current_items(changes, item, seq, deleted).groupBy(series).agg(F.count(F.lit(1)).alias("items"))
    updates = changes.where(~F.coalesce(deleted, F.lit(False)))
    rows = updates.groupBy(series).agg(F.max(seq).alias("last_seq"), F.max_by(item, F.col(seq)).alias("last_item"))
    return live.join(rows, series)


def ranked_values(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, from_, upto, n: each distinct value of each group with the places (from 0) that it takes among the group's n values.

    Values are counted first; the counts are then numbered over all groups by task offsets, so that a group with most of the rows, or with
    as many values as rows, is no one task's. Null values take no place.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_count"))
    placed = numbered_in_groups(counts, [group], [F.col(value)], "_count")
    return placed.select(group, value, F.col("before").alias("from_"), (F.col("before") + F.col("_count")).alias("upto"), F.col("group_sum").alias("n"))


def value_at(value: str, place: Column) -> Column:
    """An aggregate over ranked_values: the value at a place from 0."""
    return F.min(F.when((F.col("from_") <= place) & (place < F.col("upto")), F.col(value)))


def nearest_rank(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """group, n, at, most: the ceil(share * n)-th smallest value, not interpolated."""
    placed = ranked_values(rows, group, value)
    return placed.groupBy(group).agg(F.max("n").alias("n"), value_at(value, F.ceil(F.col("n") * share) - 1).alias("at"), F.max(value).alias("most"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The value at place n div 2 + 1 of each group."""
    return ranked_values(rows, group, value).groupBy(group).agg(value_at(value, F.floor(F.col("n") / 2)).alias("median"), F.max("n").alias("n"))


def percentile_cont(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group, at, n: the value at share * (n - 1), interpolated between its neighbours."""
    at = (F.col("n") - 1) * share
    low, high = value_at(value, F.floor(at)), value_at(value, F.ceil(at))
    found = ranked_values(rows, group, value).groupBy(group).agg(low.alias("_low"), high.alias("_high"), F.max("n").alias("n"))
    return found.select(group, (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias("at"), "n")


def account(sources: DataFrame) -> DataFrame:
    """source, extracted, kept, duplicates, rejected, complete: rejected is what remains; a source that kept more than it has is not complete."""
    rejected = F.col("extracted") - F.col("kept") - F.col("duplicates")
    return sources.select("source", "extracted", "kept", "duplicates", F.greatest(F.lit(0), rejected).alias("rejected"), (rejected >= 0).alias("complete"))

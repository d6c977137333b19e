"""Upserts that give out ids, and the rows that depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.operators.numbering import numbered
from townkit.operators.stages import written


def upsert_returning(stored: DataFrame, incoming: DataFrame, key: str, id_column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(all rows after the upsert, key and id of every incoming key): incoming rows update the stored row of their key, or get a new id.

    stored: id_column, key and the columns of incoming but for `order`; stored keys are unique. Of several incoming rows of a key the last by
    `order` wins. New ids follow the largest stored one without gaps, in the order of their keys: they are row numbers by task offsets, so
    no task sees all rows, and are written once, so that a task that runs again gives the same. Rows without a key are left out.
    """
    columns = [c for c in incoming.columns if c not in (key, order)]
    newest = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), *columns)).alias("row"))
    known = stored.select(F.col(key), F.col(id_column).alias("known_id"))
    keyed = written(newest.join(known, key, "left"), "upsert")
    first = stored.agg(F.coalesce(F.max(id_column) + 1, F.lit(0)).alias("first_id"))
    fresh = numbered(keyed.where("known_id IS NULL").drop("known_id"), [F.col(key)]).join(F.broadcast(first)).withColumn("known_id", (F.col("row_number") + F.col("first_id")).cast(stored.schema[id_column].dataType)).drop("row_number", "first_id")
    changed = keyed.where("known_id IS NOT NULL").unionByName(fresh)
    kept = stored.join(keyed.select(key), key, "left_anti")
    after = kept.unionByName(changed.select(F.col("known_id").alias(id_column), key, "row.*").select(*stored.columns))
    return after, changed.select(key, F.col("known_id").alias(id_column))


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Dependent rows with the id of their key; rows of a key that has none are left out."""
    return rows.join(ids, key)


def whole_batches(records: DataFrame, batch: str, problem: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records of the batches that are whole, a report of all batches): one bad or missing record withholds its batch, and no other.

    records: batch, problem (why a record is bad, or null) and others; expected: batch, expected (how many records it states). The report
    has batch, records, bad, first_problem (the least), expected, published. It is one aggregate with a partial step: no list is collected.
    A batch without records is reported if it is expected, and published if nothing is expected of it; a null batch is a batch.
    """
    report = records.groupBy(batch).agg(F.count(F.lit(1)).alias("records"), F.count(problem).alias("bad"), F.min(problem).alias("first_problem"))
    if expected is not None:
        other = expected.select(F.col(batch).alias("_batch"), "expected")
        report = report.join(other, F.col(batch).eqNullSafe(F.col("_batch")), "full").select(F.coalesce(batch, "_batch").alias(batch), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("bad", F.lit(0)).alias("bad"), "first_problem", "expected")
    else:
        report = report.withColumn("expected", F.lit(None).cast("long"))
    report = written(report.withColumn("published", (F.col("bad") == 0) & (F.coalesce("expected", "records") == F.col("records"))), "report")
    whole = report.where("published").select(F.col(batch).alias("_batch"))
    return records.join(whole, F.col(batch).eqNullSafe(F.col("_batch")), "left_semi"), report

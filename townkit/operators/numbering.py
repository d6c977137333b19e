"""Row numbers and running totals over a whole relation, without a window that one task must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.operators.stages import written

#: monotonically_increasing_id() is the task's number above these bits and the row's place in its task below them.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], value: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with `row_number` (long, 0, 1, 2, ... in the given order) and, if `value` is named, `sum_before` (its sum over all rows before).

    Rows are dealt to tasks by ranges of the order and sorted there; each task's count (and sum) is added to the tasks behind it. The rows
    with their places are written once, so that a task that runs again gives the same numbers. Nulls order as the columns of `order` say;
    rows that tie in all of them get neighbouring numbers in no stated order, so `order` should be total. A null value adds nothing. An
    empty table gives an empty result. Only one row for each task meets in one place.
    """
    if df.isEmpty():
        empty = df.withColumn("row_number", F.lit(0).cast("long"))
        return empty.withColumn("sum_before", F.lit(0).cast("long")) if value else empty
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id()
    placed = dealt.sortWithinPartitions(*order).select(F.struct("*").alias("row"), at.alias("at"))
    placed = written(placed.select("row", F.shiftright("at", PLACE_BITS).alias("task"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place")), "numbered")
    v = F.coalesce(F.col(f"row.{value}"), F.lit(0)) if value else F.lit(0)
    totals = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("v"))
    # one row for each task of the shuffle: its number is a setting, not a size of the data
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v_before"))
    out = placed.join(F.broadcast(offsets), "task")
    number = (F.col("n_before") + F.col("place")).alias("row_number")
    if not value:
        return out.select("row.*", number)
    here = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("row.*", number, (F.col("v_before") + F.coalesce(F.sum(v).over(here), F.lit(0))).alias("sum_before"))


def numbered_in_groups(df: DataFrame, groups: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """df with `place` (0, 1, ... in each group), `group_size` and, if `value` is named, `before` and `group_sum` of it: numbers over all rows, less those of the group's first row.

    A group of any share of the rows is dealt to many tasks. Nulls are a group like others; a null value adds nothing.
    """
    rows = numbered(df, [*(F.col(g).asc_nulls_first() for g in groups), *order], value)
    key = F.struct(*(F.col(g).alias(f"k{n}") for n, g in enumerate(groups)))
    v = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    start = F.col("sum_before") if value else F.lit(0)
    first = rows.groupBy(key.alias("_group")).agg(F.min("row_number").alias("_first"), F.count(F.lit(1)).alias("group_size"), F.min_by(start, "row_number").alias("_start"), F.sum(v).alias("group_sum"))
    out = rows.withColumn("_group", key).join(first, "_group")
    sums = [(F.col("sum_before") - F.col("_start")).alias("before"), "group_sum"] if value else []
    return out.select(*df.columns, (F.col("row_number") - F.col("_first")).alias("place"), "group_size", *sums)

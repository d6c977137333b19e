"""Slots, runs, streaks and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def slot_ledger(slots: DataFrame, runs: DataFrame, now: Column, late_minutes: int = 60) -> DataFrame:
    """workflow, slot, run_id, delay, state of every slot: the first run from the slot until the next one.

    state: MISSING or PENDING without a run, by the minutes gone; FAILED if the run did not succeed; LATE; OK. slots: workflow, slot;
    runs: workflow, run_id, created, ok. An as-of join without a product: slots and runs of a workflow are sorted together, each run
    takes the last slot before it, and a slot its first run.
    """
    s = slots.select("workflow", F.col("slot").alias("at"), F.lit(0).alias("is_run"), F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("boolean").alias("ok"))
    r = runs.select("workflow", F.col("created").alias("at"), F.lit(1).alias("is_run"), F.col("run_id").cast("long").alias("run_id"), "ok")
    both = s.union(r).withColumn("slot", F.last(F.when(F.col("is_run") == 0, F.col("at")), ignorenulls=True).over(Window.partitionBy("workflow").orderBy("at", "is_run", "run_id").rowsBetween(Window.unboundedPreceding, 0)))
    first = both.where((F.col("is_run") == 1) & F.col("slot").isNotNull()).groupBy("workflow", "slot").agg(F.min_by(F.struct("at", "run_id", "ok"), F.struct("at", "run_id")).alias("run"))
    found = slots.select("workflow", "slot").distinct().join(first, ["workflow", "slot"], "left")
    delay = F.bround(F.timestamp_diff("SECOND", F.col("slot"), F.col("run.at")) / 60).cast("long")
    waited = F.timestamp_diff("SECOND", F.col("slot"), now) / 60
    state = F.when(F.col("run").isNull(), F.when(waited > late_minutes, "MISSING").otherwise("PENDING")).when(~F.col("run.ok"), "FAILED").when(delay > late_minutes, "LATE").otherwise("OK")
    return found.select("workflow", "slot", F.col("run.run_id").alias("run_id"), delay.alias("delay"), state.alias("state"))


def streaks(rows: DataFrame, key: str, order: str, failed: str, limit: int = 3) -> DataFrame:
    """key, streak (failures since the last success, to the last row), total, deactivated: whether any streak reached the limit."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_run", F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(key, "_run").agg(F.sum(F.col(failed).cast("int")).alias("n"))
    last = runs.groupBy(key).agg(F.max_by("n", "_run").alias("streak"), F.sum("n").alias("total"), F.max("n").alias("_most"))
    return last.select(key, "streak", "total", (F.col("_most") >= limit).alias("deactivated"))


def within_budget(rows: DataFrame, group: str, order: list[Column], cost: str, budget: float) -> DataFrame:
    """All rows with `spent` before them in their group, and `taken`: whether the running sum with them is within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).withColumn("taken", F.col("spent") + F.col(cost) <= budget)


def schedule_text(slots: DataFrame, key: str) -> DataFrame:
    """key, schedule: days with their times, runs of three days and more as 'Mon–Wed'. slots: key, day (0 Sunday), time (text).

    Days of equal times are grouped, then runs of days are found as islands: the day less its place among the days is constant in a run.
    """
    days = slots.groupBy(key, "day").agg(F.array_join(F.array_sort(F.collect_set("time")), ", ").alias("times"))
    week = days.withColumn("_d", (F.col("day") + 6) % 7)  # from Monday
    placed = week.withColumn("_run", F.col("_d") - F.row_number().over(Window.partitionBy(key, "times").orderBy("_d")))
    runs = placed.groupBy(key, "times", "_run").agg(F.min("_d").alias("a"), F.max("_d").alias("b"))
    name = lambda d: F.element_at(F.array(*map(F.lit, [*DAYS[1:], DAYS[0]])), (d + 1).cast("int"))
    label = F.when(F.col("b") - F.col("a") >= 2, F.concat(name(F.col("a")), F.lit("–"), name(F.col("b")))).when(F.col("b") > F.col("a"), F.concat(name(F.col("a")), F.lit(", "), name(F.col("b")))).otherwise(name(F.col("a")))
    texts = runs.groupBy(key, "times").agg(F.min("a").alias("first"), F.array_join(F.array_sort(F.collect_list(F.struct("a", label.alias("label"))))["label"], ", ").alias("days"))
    texts = texts.withColumn("part", F.concat("days", F.lit(" "), "times"))
    return texts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "times", "part")))["part"], "; ").alias("schedule"))


def next_date(dates: Column, today: Column) -> Column:
    """The first of an array of dates that is not past."""
    return F.array_min(F.filter(dates, lambda d: d >= today))

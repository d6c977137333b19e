"""Cron schedules as sets of slots, and what ran for each slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a schedule with their least and greatest numbers, and minutes until a start, and an end, are late.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
DISPATCH_MINUTES, COMPLETION_MINUTES = 60, 240
#: Schedules whose slots one task makes.
SCHEDULES_A_TASK = 1_000


def members(field: Column, low: int, high: int) -> Column:
    """The numbers that a field names, as a set of bits: lists of *, n, n-m, each with /step. Null if a part is none of these or out of range."""
    whole = r"^(\*|[0-9]{1,2}(?:-[0-9]{1,2})?)(?:/([0-9]{1,2}))?$"

    def bits(part: Column) -> Column:
        span, step = F.regexp_extract(part, whole, 1), F.regexp_extract(part, whole, 2)
        first = F.when(span == "*", low).otherwise(F.element_at(F.split(span, "-"), 1).try_cast("int"))
        last = F.when(span == "*", high).when(span.contains("-"), F.element_at(F.split(span, "-"), -1).try_cast("int")).when(step != "", high).otherwise(first)
        by = F.when(step == "", 1).otherwise(step.try_cast("int"))
        good = (span != "") & (first >= low) & (last <= high) & (first <= last) & (by > 0)
        return F.when(good, F.aggregate(F.sequence(first, F.when(good, last).otherwise(first), F.when(good, by).otherwise(1)), F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), n))))

    parts = F.transform(F.split(field, ","), bits)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(p)))


def parsed(schedules: DataFrame) -> DataFrame:
    """schedules (workflow, cron, zone) with a set of bits for each field; a cron that cannot be read has nulls. Weekdays: 0 and 7 are Sunday."""
    parts = F.split(F.trim(F.col("cron")), r"\s+")
    rows = schedules.withColumn("p", F.when(F.size(parts) == len(FIELDS), parts))
    rows = rows.select(*schedules.columns, *(members(F.get("p", F.lit(n)), low, high).alias(name) for n, (name, low, high) in enumerate(FIELDS)), (~F.get("p", F.lit(2)).startswith("*") & ~F.get("p", F.lit(4)).startswith("*")).alias("either"))
    return rows.withColumn("weekday", F.col("weekday").bitwiseOR(F.shiftright("weekday", 7)))


def slots(schedules: DataFrame, first: str, last: str) -> DataFrame:
    """workflow, slot (UTC) of every schedule, for the local days from first to last.

    Days are a calendar that each schedule meets by its bits; hours and minutes come from their bits. A local time that clocks skip is
    the moment one hour later; one that occurs twice is the first. Where both day and weekday are restricted, either is enough. Schedules
    that cannot be read give nothing; a null zone is UTC; equal slots of a workflow are one. A few schedules are many slots, so they are
    dealt by their number, not by their bytes: no task holds the slots of more than some SCHEDULES_A_TASK.
    """
    tasks = max(1, -(-schedules.count() // SCHEDULES_A_TASK))
    rules = parsed(schedules.repartition(tasks, "workflow")).where(" AND ".join(f"{name} IS NOT NULL" for name, *_ in FIELDS))
    has = lambda bits, n: F.call_function("bit_get", bits, n.cast("int")) == 1
    days = rules.withColumn("date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    day, weekday = has(F.col("day"), F.dayofmonth("date")), has(F.col("weekday"), F.dayofweek("date") - 1)
    days = days.where(has(F.col("month"), F.month("date")) & F.when(F.col("either"), day | weekday).otherwise(day & weekday))
    each = lambda name, high: F.filter(F.sequence(F.lit(0), F.lit(high)), lambda n: has(F.col(name), n))
    times = days.withColumn("h", F.explode(each("hour", 23))).withColumn("m", F.explode(each("minute", 59)))
    local = F.make_timestamp_ntz(F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("h"), F.col("m"), F.lit(0))
    return times.select("workflow", F.convert_timezone(F.coalesce("zone", F.lit("UTC")), F.lit("UTC"), local).alias("slot")).distinct()


def ledger(expected: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """workflow, slot, run, dispatch_minutes, state of every slot: what ran between it and the next slot of its workflow.

    expected: workflow, slot; runs: workflow, run, created, finished (or null), ok. Of several runs the first counts (ties: the least run).
    state: future, missing (pending, if its hour is not over), failed, incomplete, late (started after an hour or done after four), success.
    Each run meets the one slot whose interval holds it: slots and runs of a workflow are read once, in the order of time.
    """
    both = expected.select("workflow", F.col("slot").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("run"), F.lit(None).cast("timestamp_ntz").alias("finished"), F.lit(None).cast("boolean").alias("ok"))
    both = both.unionByName(runs.select("workflow", F.col("created").alias("at"), F.lit(1).alias("kind"), F.col("run").cast("string").alias("run"), "finished", "ok"))
    order = Window.partitionBy("workflow").orderBy("at", "kind", "run").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("slot", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order))
    first = F.min(F.when(F.col("kind") == 1, F.struct("at", "run", "finished", "ok")))
    rows = placed.where(F.col("slot").isNotNull()).groupBy("workflow", "slot").agg(first.alias("r"))
    minutes = lambda a, b: F.timestamp_diff("SECOND", a, b) / 60
    dispatch = F.round(minutes(F.col("slot"), F.col("r.at")), 2)
    late = (dispatch > DISPATCH_MINUTES) | (minutes(F.col("slot"), F.col("r.finished")) > COMPLETION_MINUTES)
    waiting = F.when(minutes(F.col("slot"), now) > DISPATCH_MINUTES, "missing").otherwise("pending")
    state = F.when(F.col("slot") > now, "future").when(F.col("r").isNull(), waiting).when(F.col("r.finished").isNull(), "incomplete").when(~F.coalesce("r.ok", F.lit(False)), "failed").when(late, "late").otherwise("success")
    return rows.select("workflow", "slot", F.col("r.run").alias("run"), dispatch.alias("dispatch_minutes"), state.alias("state"))

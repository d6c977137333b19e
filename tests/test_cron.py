from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from townkit.operators import cron


def brute(workflow, rule, zone, first, last):
    def named(field, low, high):
        out = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span else high if step else int(span))
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    fields = rule.split()
    minute, hour, day, month, week = (named(f, low, high) for f, (_, low, high) in zip(fields, cron.FIELDS))
    week = {w % 7 for w in week}
    found, d = set(), first
    while d <= last:
        by_day, by_week = d.day in day, (d.weekday() + 1) % 7 in week
        ok = by_day or by_week if fields[2][0] != "*" and fields[4][0] != "*" else by_day and by_week
        if d.month in month and ok:
            for h in hour:
                for m in minute:
                    local = datetime(d.year, d.month, d.day, h, m, tzinfo=ZoneInfo(zone))
                    found.add((workflow, local.astimezone(UTC).replace(tzinfo=None)))
        d += timedelta(days=1)
    return found


RULES = [("a", "17 7,19 * * *", "Europe/London"), ("b", "*/20 0-3 * * *", "Europe/London"), ("c", "0 12 1,15 * 5", "UTC"), ("d", "5 4 29 2 *", "UTC"), ("e", "30 1 * 3,10 0", "Europe/London"), ("f", "0 6 * * 7", "America/New_York"), ("a", "17 7 * * 1-5", "Europe/London"), ("g", "10/25 5 */10 * *", "UTC")]
BAD = [("x", "60 1 * * *", "UTC"), ("x", "1 2 3 4", "UTC"), ("x", "a * * * *", "UTC"), ("x", "5-1 * * * *", "UTC"), ("x", None, "UTC"), ("x", "*/0 * * * *", "UTC"), ("x", "1,, * * * *", "UTC")]


def test_a_year_of_slots_across_both_clock_changes(spark):
    rows = spark.createDataFrame(RULES + BAD, "workflow string, cron string, zone string")
    found = sorted((r["workflow"], r["slot"]) for r in cron.slots(rows, "2024-01-01", "2024-12-31").collect())
    expected = set().union(*(brute(*r, date(2024, 1, 1), date(2024, 12, 31)) for r in RULES))
    assert found == sorted(expected)
    assert cron.slots(rows.limit(0), "2024-01-01", "2024-01-02").count() == 0


def test_ledger(spark):
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    slots = spark.createDataFrame([("w", at(h)) for h in (1, 3, 5, 7, 9, 11, 13)] + [("v", at(1))], "workflow string, slot timestamp_ntz")
    runs = [("w", 1, at(0, 30), at(0, 40), True), ("w", 2, at(1, 5), at(1, 30), True), ("w", 3, at(1, 50), at(2, 0), False), ("w", 4, at(3), at(3, 10), False), ("w", 5, at(6, 30), at(6, 40), True), ("w", 6, at(7, 10), None, None), ("u", 7, at(1), at(1), True)]
    runs = spark.createDataFrame(runs, "workflow string, run int, created timestamp_ntz, finished timestamp_ntz, ok boolean")
    found = sorted((r["workflow"], r["slot"].hour, r["run"], r["state"]) for r in cron.ledger(slots, runs, F.lit("2024-05-01 11:30:00").cast("timestamp_ntz")).collect())
    assert found == [("v", 1, None, "missing"), ("w", 1, "2", "success"), ("w", 3, "4", "failed"), ("w", 5, "5", "late"), ("w", 7, "6", "incomplete"), ("w", 9, None, "missing"), ("w", 11, None, "pending"), ("w", 13, None, "future")]


def test_slots_are_dealt_by_the_number_of_schedules(spark, monkeypatch):
    monkeypatch.setattr(cron, "SCHEDULES_A_TASK", 10)
    schedules = spark.range(100).selectExpr("id AS workflow", "'0 6 * * *' AS cron", "'UTC' AS zone")
    tasks = cron.slots(schedules, "2024-01-01", "2024-01-31").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 3_100 and len(tasks) >= 5

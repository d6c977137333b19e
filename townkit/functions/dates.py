"""Civil dates in London, slots, and dates out of text. A clock is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

LONDON = "Europe/London"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def instant(as_of: str | datetime) -> Column:
    """A UTC clock as a timestamp without zone."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def to_london(utc: Column) -> Column:
    """London wall time of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LONDON), utc)


def from_london(local: Column) -> Column:
    return F.convert_timezone(F.lit(LONDON), F.lit("UTC"), local)


def london_date(utc: Column) -> Column:
    return to_london(utc).cast("date")


def month_bounds(utc: Column) -> tuple[Column, Column]:
    """UTC instants of the start of the London month, and of the next."""
    start = F.trunc(london_date(utc), "month")
    return from_london(start.cast("timestamp_ntz")), from_london(F.add_months(start, 1).cast("timestamp_ntz"))


def next_daily_run(utc: Column, times: tuple[str, ...] = ("07:17", "19:17")) -> Column:
    """The next of the London wall times after a UTC instant, as a UTC instant: right across clock changes."""
    today = london_date(utc)
    slots = [from_london(F.concat(F.date_add(today, d).cast("string"), F.lit(f" {t}:00")).cast("timestamp_ntz")) for d in (0, 1) for t in times]
    return F.least(*(F.when(s > utc, s) for s in slots))


def weekday(day: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(day) - 1


def weekend(day: Column) -> tuple[Column, Column]:
    """(Saturday, Sunday) of the coming weekend, or of this one."""
    saturday = F.when(weekday(day) == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, (6 - weekday(day)).cast("int")))
    return saturday, F.date_add(saturday, 1)


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    return (start <= last) & (F.coalesce(end, start) >= first)


def strict_date(value: Column) -> Column:
    """A date in YYYY-MM-DD that exists, else null."""
    parsed = F.try_to_date(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")
    return F.when(parsed.cast("string") == value, parsed)


def english_dates(text: Column) -> Column:
    """All dates like '3 May 2024' in a text that exist, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d{{1,2}}) ({MONTHS}) (\d{{4}})"), F.lit(0))
    return F.filter(F.transform(found, lambda d: F.try_to_date(d, "d MMMM yyyy")), lambda d: d.isNotNull())


def infer_year(month: Column, day: Column, today: Column) -> Column:
    """A date without a year: this year's, or next year's if that is over 45 days gone."""
    this = F.make_date(F.year(today), month, day)
    return F.when(this < F.date_sub(today, 45), F.add_months(this, 12)).otherwise(this)


def age_hours(at: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", at, now) / 3600.0


def relative_age(at: Column, now: Column) -> Column:
    """'just now', '5m ago', '3h ago', '2d ago'."""
    minutes = F.floor(F.timestamp_diff("SECOND", at, now) / 60)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def year_month(value: Column) -> Column:
    """The first day of a month written as yyyymm."""
    return F.try_to_date(F.concat(value, F.lit("01")), "yyyyMMdd")


#: Months and zones of mail dates, with the zones' hours.
MAIL_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MAIL_ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
MAIL_DATE = r"^\s*(?:[a-z]{3},?\s+)?([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{4})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([+-][0-9]{4}|[a-z]{1,3}))?\s*$"


def mail_instant(value: Column) -> Column:
    """The UTC instant of a mail date ('Tue, 5 Mar 2024 09:10:00 +0100'); without a zone, or with one that is not known, it is UTC. Null if there is no such time."""
    low = F.lower(value)
    part = lambda n: F.regexp_extract(low, MAIL_DATE, n)
    number = lambda n: F.nullif(part(n), F.lit("")).cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MAIL_MONTHS)), part(2)), F.lit(0)).cast("int")
    day = F.try_make_timestamp_ntz(number(3), month, number(1), number(4), number(5), F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)"))
    zones = F.create_map(*(F.lit(x) for name, hours in MAIL_ZONES.items() for x in (name, hours * 60)))
    digits = F.substring(part(7), 2, 2).try_cast("int") * 60 + F.substring(part(7), 4, 2).try_cast("int")
    minutes = F.when(part(7).startswith("+"), digits).when(part(7).startswith("-"), -digits).otherwise(F.coalesce(F.try_element_at(zones, part(7)), F.lit(0)))
    return F.when(low.rlike(MAIL_DATE), day - F.make_dt_interval(mins=minutes))


def mail_date(instant: Column) -> Column:
    """A UTC instant as a mail date with the zone +0000."""
    return F.concat(F.date_format(instant, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def epoch_mail_date(seconds: Column) -> Column:
    """Seconds since 1970 as a mail date; empty for none."""
    return F.coalesce(mail_date(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))), F.lit(""))

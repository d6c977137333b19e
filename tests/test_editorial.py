from datetime import UTC, date, datetime
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from townkit.functions import dates
from townkit.operators import editorial


def test_due_slots_and_topics(spark):
    at = ["2024-07-05 06:16", "2024-07-05 06:17", "2024-12-05 07:16", "2024-12-05 07:17", None]
    rows = spark.createDataFrame([(t and datetime.fromisoformat(t),) for t in at], "t timestamp_ntz").select(editorial.due_slots(F.col("t")).alias("s")).collect()
    day, winter = date(2024, 7, 5), date(2024, 12, 5)
    assert [[tuple(s) for s in r["s"]] for r in rows] == [[], [("daily", day), ("weekly", day)], [], [("daily", winter)], []]
    found = spark.range(1).select(*(editorial.topic_place(F.lit(c), F.lit("2024-07-05").cast("date")).alias(c) for c in ("daily", "weekly"))).collect()[0]
    assert tuple(found) == (day.toordinal(), day.toordinal() // 7)


@pytest.mark.parametrize("value", ["Tue, 5 Mar 2024 09:10:11 +0100", "05 mar 2024 09:10 GMT", "Fri, 29 Feb 2024 23:59:59 -0530", "1 Jan 2024 00:00:00 EST", "Mon, 1 Jan 2024 00:00:00"])
def test_mail_dates(spark, value):
    found = spark.range(1).select(dates.mail_instant(F.lit(value)).alias("v"), dates.mail_date(dates.mail_instant(F.lit(value))).alias("w")).collect()[0]
    expected = parsedate_to_datetime(value)
    expected = (expected if expected.tzinfo else expected.replace(tzinfo=UTC)).astimezone(UTC)
    assert found["v"] == expected.replace(tzinfo=None) and found["w"] == expected.strftime("%a, %d %b %Y %H:%M:%S +0000")


def test_no_dates(spark):
    rows = spark.createDataFrame([("30 Feb 2024 10:00 GMT",), ("soon",), ("",), (None,), ("1 Foo 2024 10:00",)], "v string")
    assert all(r["v"] is None for r in rows.select(dates.mail_instant(F.col("v")).alias("v")).collect())
    assert [r["v"] for r in spark.createDataFrame([(0.0,), (None,)], "s double").select(dates.epoch_mail_date(F.col("s")).alias("v")).collect()] == ["Thu, 01 Jan 1970 00:00:00 +0000", ""]


def test_posts(spark):
    def post(n, title="A fine title", summary="s" * 50, sections=3, heading="Heading", paragraphs=2, text="word " * 40, cadence="daily"):
        return (n, cadence, title, summary), [(n, k, heading) for k in range(sections)], [(n, k, text) for k in range(sections) for _ in range(paragraphs)]

    cases = [post(1), post(2, title="short"), post(3, summary=None), post(4, title=" Known TITLE "), post(5, sections=1), post(6, heading="x"), post(7, paragraphs=5), post(8, text="too short"), post(9, cadence="weekly"), post(10, text="see <b> here " * 20, paragraphs=1), post(11, summary="s" * 40 + " www.x"), post(12, paragraphs=0), post(13, text="word " * 25, paragraphs=2)]
    frame = lambda k, schema: spark.createDataFrame([c[0] for c in cases] if k == 0 else [r for c in cases for r in c[k]], schema)
    found = editorial.post_problems(frame(0, "post int, cadence string, title string, summary string"), frame(1, "post int, section int, heading string"), frame(2, "post int, section int, text string"), spark.createDataFrame([("known title",), (None,)], "title string"))
    unwanted = "Content contains unsupported markup, links or placeholders"
    assert {r["post"]: (r["problem"], r["hint"]) for r in found.collect()} == {
        1: (None, "cut 10"), 2: ("Invalid title", "cut 10"), 3: ("Invalid summary", "cut 10"), 4: ("Duplicate title", "cut 10"), 5: ("Invalid sections", "add 80"), 6: ("Invalid section heading", "cut 10"), 7: ("Invalid paragraphs", "cut 370"),
        8: ("Invalid paragraphs", "add 148"), 9: ("Invalid word count: 240", "add 310"), 10: (unwanted, None), 11: (unwanted, "cut 10"), 12: ("Invalid paragraphs", "add 160"), 13: (None, "add 10"),
    }

"""Rules of written posts: when they are due, and what makes one unfit to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions.dates import to_london
from townkit.functions.text import words_pattern

#: When a day's post is due in London, lengths of the parts, and words of the body by cadence, allowed and aimed at.
DUE_HOUR, DUE_MINUTE, WEEKLY_ON = 7, 17, 4
TITLE, SUMMARY, SECTIONS, HEADING, PARAGRAPHS, PARAGRAPH = (10, 120), (40, 320), (2, 7), (3, 100), (1, 4), (20, 1800)
ALLOWED_WORDS, TARGET_WORDS = {"daily": (130, 300), "weekly": (450, 900)}, {"daily": (160, 230), "weekly": (550, 750)}
PLACEHOLDERS = ("as an ai", "placeholder", "lorem ipsum")
UNWANTED = r"(?i)https?://|www\.|<[^>]+>|\[[^\]]+\]\(|" + words_pattern(PLACEHOLDERS, " ")


def due_slots(now: Column) -> Column:
    """The slots that are due at an instant (UTC): array of (cadence, day). After 07:17 in London one a day, on Fridays a weekly one too."""
    local = to_london(now)
    day = local.cast("date")
    is_due = (F.hour(local) * 60 + F.minute(local)) >= DUE_HOUR * 60 + DUE_MINUTE
    slot = lambda cadence: F.struct(F.lit(cadence).alias("cadence"), day.alias("day"))
    nothing = F.array().cast("array<struct<cadence:string,day:date>>")
    return F.when(~is_due | now.isNull(), nothing).when(F.weekday(day) == WEEKLY_ON, F.array(slot("daily"), slot("weekly"))).otherwise(F.array(slot("daily")))


def topic_place(cadence: Column, day: Column) -> Column:
    """Where a slot begins in the turn of topics: its day's number, or its week's. The first of January of year 1 is day 1."""
    number = F.date_diff(day, F.lit("0001-01-01").cast("date")) + 1
    return F.when(cadence == "weekly", F.floor(number / 7)).otherwise(number).cast("long")


def within(value: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(value.between(*bounds), F.lit(False))


def by_cadence(cadence: Column, bounds: dict[str, tuple[int, int]], side: int) -> Column:
    return F.when(cadence == "daily", bounds["daily"][side]).otherwise(bounds["weekly"][side])


def post_problems(posts: DataFrame, sections: DataFrame, paragraphs: DataFrame, published: DataFrame) -> DataFrame:
    """post, problem, words, hint of every post: the first rule that it breaks (null: none), the words of its body, and what its length lacks against the brief.

    posts: post, cadence, title, summary; sections: post, section, heading; paragraphs: post, section, text; published: title. Titles are
    compared trimmed and in lower case. Markup, links and placeholders are looked for part by part. Rules are counts and sums by post with
    a partial step, so that a post of any length is no list. Null parts break their rule.
    """
    def unwanted(part: Column) -> Column:
        return F.coalesce(part.rlike(UNWANTED), F.lit(False))

    length = F.length("text")
    each = paragraphs.groupBy("post", "section").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~within(length, PARAGRAPH), 1)).alias("bad"), F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))).alias("words"), F.max(unwanted(F.col("text"))).alias("unwanted")
    )
    parts = sections.join(each, ["post", "section"], "left").groupBy("post").agg(
        F.count(F.lit(1)).alias("sections"), F.count(F.when(~within(F.length("heading"), HEADING), 1)).alias("bad_headings"), F.count(F.when(~within(F.col("n"), PARAGRAPHS) | (F.col("bad") > 0), 1)).alias("bad_sections"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.max(F.coalesce("unwanted", F.lit(False)) | unwanted(F.col("heading"))).alias("unwanted"),
    )
    key = lambda c: F.lower(F.trim(c))
    known = published.select(key(F.col("title")).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    rows = posts.join(parts, "post", "left").withColumn("_key", key(F.col("title"))).join(known, "_key", "left")
    words, cadence = F.coalesce("words", F.lit(0)), F.col("cadence")
    low, high = by_cadence(cadence, TARGET_WORDS, 0), by_cadence(cadence, TARGET_WORDS, 1)
    allowed = words.between(by_cadence(cadence, ALLOWED_WORDS, 0), by_cadence(cadence, ALLOWED_WORDS, 1))
    problem = (
        F.when(~within(F.length(F.trim("title")), TITLE), "Invalid title").when(~within(F.length(F.trim("summary")), SUMMARY), "Invalid summary").when(F.col("_known"), "Duplicate title")
        .when(~within(F.col("sections"), SECTIONS), "Invalid sections").when(F.col("bad_headings") > 0, "Invalid section heading").when(F.col("bad_sections") > 0, "Invalid paragraphs")
        .when(~allowed, F.concat(F.lit("Invalid word count: "), words)).when(F.col("unwanted") | unwanted(F.col("title")) | unwanted(F.col("summary")), "Content contains unsupported markup, links or placeholders")
    )
    hint = F.when(words < low, F.concat(F.lit("add "), low - words)).when(words > high, F.concat(F.lit("cut "), words - high))
    return rows.select("post", problem.alias("problem"), words.alias("words"), hint.alias("hint"))

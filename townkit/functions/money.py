"""Prices out of text, and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions import text

#: Words of things that cost much, and of those in between.
BIG_WORDS = (
    "car seat", "pushchair", "pram", "stroller", "travel system", "cot", "crib",
    "bed", "bunk", "mattress", "highchair", "high chair", "monitor", "carrier",
    "bassinet", "playpen", "swing set", "trampoline", "climbing frame",
    "playhouse", "bicycle", "bike", "tablet", "membership", "season pass",
    "wagon", "breast pump", "desk", "luggage", "smartwatch",
)
MID_WORDS = (
    "sterilis", "steriliz", "warmer", "gate", "bath", "bottle", "tickets",
    "admission", "skates", "toys", "set", "blocks", "headphones", "camera",
    "blackout", "humidifier", "rocking", "glider", "dresser", "formula",
    "nappies", "nappy", "wipes", "coat", "snowsuit", "boots", "shoes", "sandbox",
    "paddling", "play gym", "bookshelf",
)

AMOUNT = r"£\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def parse_number(value: Column) -> Column:
    """A finite number without currency sign and thousands commas, else null."""
    plain = F.regexp_replace(F.trim(value), r"[£,]", "")
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.try_to_number(plain, F.lit("S9999999999.9999")).cast("double"))


def labelled_amount(text: Column, label: str) -> Column:
    return parse_number(F.nullif(F.regexp_extract(F.lower(text), rf"\b(?:{label})\b:?\s*{AMOUNT}", 1), F.lit("")))


def amounts(text: Column) -> tuple[Column, Column]:
    """(now, was) of an offer's text: an amount after 'now', else the first one; an amount after 'was' or 'rrp'."""
    now = F.coalesce(labelled_amount(text, "now|only"), parse_number(F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit(""))))
    return now, labelled_amount(text, "was|rrp")


def prices(text: Column) -> tuple[Column, Column, Column]:
    """(price, was, discount in percent) of an offer's text: a price after 'now', else the first amount; a was-price after 'was' or 'rrp'."""
    return compared(*amounts(text))


def compared(now: Column, was: Column) -> tuple[Column, Column, Column]:
    usable = F.when(was > now, was)
    return now, usable, F.bround((usable - now) / usable * 100, 1)


def with_prices(rows: DataFrame, text: Column) -> DataFrame:
    """rows with price, was and discount, as prices gives them; each amount is read once a row, and comparisons take the columns."""
    now, was = amounts(F.col("_text"))
    read = rows.withColumn("_text", text).withColumns({"_now": now, "_was": was})
    price, was, discount = compared(F.col("_now"), F.col("_was"))
    return read.withColumns({"price": price, "was": was, "discount": discount}).drop("_text", "_now", "_was")


def is_exact_pence(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]+\.[0-9]{2}$"), F.lit(False))


def shown(value: Column) -> Column:
    """'£a' with two digits; null without a value."""
    return F.concat(F.lit("£"), F.when(value.isNotNull(), F.format_string("%.2f", value)))


def price_text(low: Column, high: Column) -> Column:
    """'Free', '£a' or '£a–£b'; null without prices."""
    return F.when(low.isNull(), None).when((low == 0) & (high == 0), "Free").when(low == high, shown(low)).otherwise(F.concat(shown(low), F.lit("–"), shown(high)))


def value_band(title: Column) -> Column:
    """big, mid or low, by words that stand anywhere in the title."""
    plain = text.norm_listing(title)
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), plain.contains)
    return F.when(holds(BIG_WORDS), "big").when(holds(MID_WORDS), "mid").otherwise("low")

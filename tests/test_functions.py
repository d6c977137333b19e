"""Column functions on single values: borders, nulls, and changes of one field."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from townkit.functions import dates, geo, money, places, text, urls
from townkit.functions.similarity import ratio


def value(spark, column, **fields):
    rows = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items())) if fields else spark.range(1)
    return rows.select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (text.norm_text, "The Fish & Chip-Shop!", "the fish and chip shop"),
        (text.norm_text, None, ""),
        (text.norm_title, "The Art of a Walk", "art of walk"),
        (text.norm_name, "Soft Play Ltd", "soft play"),
        (text.title_key, "Big News - The Paper", "bignews"),
        (text.norm_terms, "Children's Café, £5", "childrens caf 5"),
        (text.category_slug, "Soft & Play-Area", "soft_play_area"),
        (text.slugify, "  Café Été!! ", "cafe-ete"),
        (text.slugify, "!!", "item"),
        (text.id_from_slug, "a-b--42", "42"),
        (text.id_from_slug, "a-b", None),
        (text.display_title, "Coat — Default Title", "Coat"),
        (text.clean_text, "<p>A &amp; B</p>\n c", "A & B c"),
        (text.xml_escape, "a<b&'c'", "a&lt;b&amp;&apos;c&apos;"),
        (urls.identity_url, "HTTPS://A.org/X/#y", "https://a.org/x"),
        (urls.clean_url, "https://a.org/x?utm_source=q&id=3&fbclid=9#t", "https://a.org/x?id=3"),
        (urls.clean_url, "https://a.org/x?gclid=9", "https://a.org/x"),
        (urls.canonical_link, "https://A.org/X/?b=2&a=1#f", "https://a.org/X?a=1&b=2"),
        (urls.host_group, "https://www.shop.example.co.uk/x", "example.co.uk"),
        (urls.host_group, "https://a.b.example.com:8080/", "example.com"),
        (urls.website_identity, "https://www.facebook.com/x", None),
        (urls.is_public_link, "https://user:pw@a.org/", False),
        (urls.is_public_link, "javascript:alert(1)", False),
        (urls.is_public_link, "https://a.org/x", True),
        (money.parse_number, "£1,234.50", 1234.5),
        (money.parse_number, "free", None),
        (money.is_exact_pence, "12.5", False),
        (money.value_band, "Half-price coats", "mid"),
        (money.value_band, "Toddler Car-Seat & toys", "big"),
        (money.value_band, None, "low"),
        (places.normalise_postcode, "sw1a1aa", "SW1A 1AA"),
        (places.normalise_postcode, "m1", "M1"),
        (places.find_postcode, "at 1 High St, m1 1ae.", "M1 1AE"),
        (places.postcode_district, "SW1A 1AA", "SW1A"),
        (places.place_token, "Greater-Town Council", "greater_town"),
        (places.place_token, "Nationwide", None),
        (dates.strict_date, "2024-02-30", None),
        (dates.strict_date, "2024-02-29", date(2024, 2, 29)),
        (dates.year_month, "202403", date(2024, 3, 1)),
    ],
)
def test_values(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_trim_is_before_the_cut(spark):
    assert value(spark, text.trim_to_null(F.lit("   abc"), 2)) == "ab"
    assert value(spark, text.trim_to_null(F.lit("   "), 2)) is None


def test_needle_is_cut_at_a_hundred(spark):
    assert value(spark, text.contains_folded([F.lit("x" * 100)], "X" * 101))
    assert not value(spark, text.contains_folded([F.lit("abc")], "abd"))


def test_rolling_hash(spark):
    h = 0
    for c in "Museum day":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert value(spark, text.rolling_hash(F.lit("Museum day"), 97)) == h % 97


def test_word_sets_and_similarity(spark):
    assert value(spark, text.word_set(F.lit("The big day of the fair - Paper"))) == ["the", "big", "day", "fair"]
    assert value(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert value(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_ratio_is_ratcliff_obershelp(spark):
    from difflib import SequenceMatcher

    assert value(spark, ratio(F.lit("abcd"), F.lit("bcde"))) == SequenceMatcher(None, "abcd", "bcde").ratio()


def test_distance(spark):
    assert abs(value(spark, geo.haversine(51.5, -0.12, 48.85, 2.35)) - 341) < 3
    assert value(spark, geo.haversine(0.0, 0.0, 0.0, 180.0)) == pytest.approx(geo.KM_DIAMETER * 3.141592653589793 / 2)
    assert value(spark, geo.haversine(0.0, 0.0, F.lit(None).cast("double"), F.lit(1.0))) is None


@pytest.mark.parametrize(("lat", "lng", "ok"), [(90.0, 180.0, True), (90.1, 0.0, False), (0.0, -180.5, False), (None, 1.0, False)])
def test_points(spark, lat, lng, ok):
    assert value(spark, geo.valid_point(F.lit(lat).cast("double"), F.lit(lng))) is ok


def test_box_holds_the_circle():
    south, north, west, east = geo.box(53.5, -2.5, 100)
    assert south < 53.5 - 0.89 and north > 53.5 + 0.89 and east + 2.5 > 1.5
    assert geo.box(89.9, 0, 100) is None and geo.box(0, 179.9, 100) is None


def test_prices(spark):
    price, was, discount = money.prices(F.lit("Was £20.00 now £15.00"))
    assert (value(spark, price), value(spark, was), value(spark, discount)) == (15.0, 20.0, 25.0)
    price, was, _ = money.prices(F.lit("Only £5, rrp £4"))
    assert (value(spark, price), value(spark, was)) == (5.0, None)  # a was-price that is lower is none


@pytest.mark.parametrize(("low", "high", "shown"), [(0.0, 0.0, "Free"), (2.0, 2.0, "£2.00"), (2.0, 3.5, "£2.00–£3.50"), (None, None, None)])
def test_price_text(spark, low, high, shown):
    assert value(spark, money.price_text(F.lit(low).cast("double"), F.lit(high).cast("double"))) == shown


def test_london_across_the_clock_change(spark):
    run = lambda s: value(spark, dates.next_daily_run(dates.instant(s)))
    assert run("2024-03-30 20:00:00") == datetime(2024, 3, 31, 6, 17)  # summer time from that morning
    assert run("2024-01-10 07:00:00") == datetime(2024, 1, 10, 7, 17)
    assert value(spark, dates.london_date(dates.instant("2024-06-30 23:30:00"))) == date(2024, 7, 1)
    start, end = dates.month_bounds(dates.instant("2024-03-15 00:00:00"))
    assert (value(spark, start), value(spark, end)) == (datetime(2024, 3, 1), datetime(2024, 3, 31, 23))


@pytest.mark.parametrize(("day", "saturday"), [("2024-05-31", "2024-06-01"), ("2024-06-01", "2024-06-01"), ("2024-06-02", "2024-06-01"), ("2024-06-03", "2024-06-08")])
def test_weekend(spark, day, saturday):
    assert str(value(spark, dates.weekend(F.lit(day).cast("date"))[0])) == saturday


def test_dates_in_text(spark):
    assert value(spark, dates.english_dates(F.lit("from 3 May 2024 to 31 June 2024, then 4 June 2024"))) == [date(2024, 5, 3), date(2024, 6, 4)]
    assert value(spark, dates.infer_year(F.lit(1), F.lit(5), F.lit("2024-12-20").cast("date"))) == date(2025, 1, 5)
    assert value(spark, dates.infer_year(F.lit(11), F.lit(20), F.lit("2024-12-20").cast("date"))) == date(2024, 11, 20)


@pytest.mark.parametrize(("given", "least", "most"), [("3-5 years", 3, 5), ("18 months to 4", 1, 4), ("under 5s", 0, 4), ("8+", 8, None), ("all", None, None)])
def test_ages(spark, given, least, most):
    a, b = places.age_band(F.lit(given))
    assert (value(spark, a), value(spark, b)) == (least, most)


@pytest.mark.parametrize(("a", "b", "country"), [("E01", "E02", "england"), ("E01", "W02", "conflict"), (None, "S02", "scotland"), (None, None, None)])
def test_country(spark, a, b, country):
    assert value(spark, places.resolve_country(F.lit(a).cast("string"), F.lit(b).cast("string"))) == country


def test_cells_round_half_to_even(spark):
    assert value(spark, geo.cell(F.lit(0.125), F.lit(-0.375), 2)).asDict() == {"y": 12, "x": -38}
    assert len(value(spark, geo.cells_around(F.lit(1.0), F.lit(2.0)))) == 9


def test_ratios_are_those_of_the_library():
    """Over a small alphabet (many equal runs), names, long texts (frequent characters are left out from 200 on), nulls and empty texts."""
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    from townkit.functions import similarity

    r, a, b = random.Random(7), [None, "", "", "ab" * 150, "\0a\0"], ["x", "", "x", "ba" * 140, "a\0\0"]
    for signs in ("ab", "customer 0123456789", "".join(chr(300 + i) for i in range(400)) + "\N{GRINNING FACE}"):
        for _ in range(600):
            a.append("".join(r.choices(signs, k=r.randint(0, r.choice((6, 20, 70))))))
            b.append("".join(r.choices(signs, k=r.randint(0, 20))) if r.random() < 0.5 else a[-1][r.randint(0, 3) :] + a[-1][: r.randint(0, 9)])
    found = similarity.ratios(pd.Series(a), pd.Series(b))
    assert found[0] != found[0]
    assert list(found[1:]) == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a[1:], b[1:], strict=True)]
    assert len(similarity.ratios(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0

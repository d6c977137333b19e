"""Postcodes, countries, ages and place tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSTCODE = r"[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}"
#: The first letter of an official area code, by country.
COUNTRIES = {"E": "england", "N": "northern_ireland", "S": "scotland", "W": "wales"}
PSEUDO_PLACES = ("uk", "unknown", "nationwide", "online")


def normalise_postcode(value: Column) -> Column:
    """Upper case with one space before the last three characters, from five characters on."""
    compact = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9]", ""))
    return F.when(F.length(compact) >= 5, F.regexp_replace(compact, r"(.{3})$", " $1")).otherwise(compact)


def stated_postcode(value: Column) -> Column:
    """As normalise_postcode, but only white space is taken out; empty if there is none."""
    compact = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"\s+", "")
    return F.when(F.length(compact) >= 5, F.regexp_replace(compact, r"(.{3})$", " $1")).otherwise(compact)


def find_postcode(text: Column) -> Column:
    found = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), rf"\b{POSTCODE}\b", 0)
    return F.when(found != "", normalise_postcode(found))


def postcode_area(postcode: Column) -> Column:
    return F.nullif(F.regexp_extract(postcode, r"^[A-Z]{1,2}", 0), F.lit(""))


def postcode_district(postcode: Column) -> Column:
    return F.nullif(F.regexp_extract(postcode, r"^([A-Z]{1,2}[0-9][A-Z0-9]?) ", 1), F.lit(""))


def postcode_sector(postcode: Column) -> Column:
    return F.nullif(F.regexp_extract(postcode, r"^([A-Z]{1,2}[0-9][A-Z0-9]? [0-9])", 1), F.lit(""))


def place_token(value: Column, most: int = 100) -> Column:
    """Underscored token of a place; null for names of no place."""
    token = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    token = F.substring(F.regexp_replace(token, r"_(council|borough|district)$", ""), 1, most)
    return F.when((token != "") & ~token.isin(*PSEUDO_PLACES), token)


def country_of(code: Column) -> Column:
    pairs = [F.lit(x) for pair in COUNTRIES.items() for x in pair]
    return F.create_map(*pairs)[F.substring(code, 1, 1)]


def resolve_country(postcode_code: Column, authority_code: Column) -> Column:
    """The country that both codes give, or the one that is known; 'conflict' if they differ; null if neither is known."""
    a, b = country_of(postcode_code), country_of(authority_code)
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), "conflict").otherwise(F.coalesce(a, b))


def age_band(text: Column) -> tuple[Column, Column]:
    """(least, most) age in years out of '3-5 years', '18 months to 4', 'under 5s', '8+'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = r"(\d+)\s*(months?|m\b)?(?:\s*years?|\s*yrs?)?\s*(?:-|–|to)\s*(\d+)\s*(months?)?"
    years = lambda n, unit: F.when(F.regexp_extract(low, pattern, unit) != "", F.floor(F.regexp_extract(low, pattern, n).try_cast("int") / 12)).otherwise(F.regexp_extract(low, pattern, n).try_cast("int"))
    under, plus = F.regexp_extract(low, r"under\s*(\d+)", 1).try_cast("int"), F.regexp_extract(low, r"(\d+)\s*\+", 1).try_cast("int")
    has_range = low.rlike(pattern)
    least = F.when(has_range, years(1, 2)).when(under.isNotNull(), 0).otherwise(plus)
    most = F.when(has_range, years(3, 4)).when(under.isNotNull(), under - 1)
    return least.cast("int"), most.cast("int")


def age_state(least: Column, most: Column, oldest: int = 12) -> Column:
    """'eligible', 'outside' or 'unknown' for children of up to `oldest`."""
    return F.when(least.isNull() & most.isNull(), "unknown").when(F.coalesce(least, F.lit(0)) > oldest, "outside").otherwise("eligible")

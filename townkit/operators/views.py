"""Views with a clock, given as an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upcoming_events(listings: DataFrame, today: str) -> DataFrame:
    """Events with a start that are not over."""
    return listings.where((F.col("kind") == "event") & F.col("start").isNotNull() & (F.coalesce("end", "start") >= F.lit(today).cast("date")))


def current_activities(listings: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Activities seen within the last days."""
    return listings.where((F.col("kind") == "activity") & (F.col("last_seen") >= F.date_sub(F.lit(today).cast("date"), days)))


def feed_items(news: DataFrame, today: str, least: int = 3, days: int = 14) -> DataFrame:
    """News that is relevant, not hidden, primary or not known to be otherwise, and younger than the days."""
    primary = F.coalesce("primary", F.lit(True)) if "primary" in news.columns else F.lit(True)
    return news.where((F.col("relevance") >= least) & primary & ~F.coalesce("hidden", F.lit(False)) & (F.col("published") > F.date_sub(F.lit(today).cast("date"), days)))


def news_near(news: DataFrame, nation: str, region: str | None = None, district: str | None = None, county: str | None = None) -> DataFrame:
    """News for a place: of the country, of the nation as a whole, not placed, of the region, of the district, or of the county without a district."""
    c = F.col
    keep = (c("geo_nation") == "uk") | ((c("geo_nation") == nation) & c("geo_region").isNull() & c("geo_district").isNull()) | c("geo_nation").isNull()
    if region:
        keep |= (c("geo_region") == region) & c("geo_district").isNull()
    if district:
        keep |= c("geo_district") == district
    if county:
        keep |= (c("geo_county") == county) & c("geo_district").isNull()
    return news.where(F.coalesce(keep, F.lit(False)))


def due(subjects: DataFrame, runs: DataFrame, now: str, fresh_days: int = 180, retry_days: int = 7, n: int = 10) -> DataFrame:
    """The first n subjects without a fresh run: a success within fresh_days, a failure within retry_days. subjects: id; runs: id, ok, ran_at."""
    at = F.lit(now).cast("timestamp_ntz")
    age = F.timestamp_diff("DAY", F.col("ran_at"), at)
    fresh = runs.where((F.col("ok") & (age < fresh_days)) | (~F.col("ok") & (age < retry_days))).select("id").distinct()
    return subjects.join(fresh, "id", "left_anti").orderBy("id").limit(n)

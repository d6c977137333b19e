"""Rules over offers and items: reasons, applicability, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions import urls


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition holds; a null condition does not. Null if none does."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))


def all_reasons(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, as an array."""
    return F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)), lambda r: r.isNotNull())


def worth_having(saving: Column, pct: Column) -> Column:
    """A saving of 10 at 10 %, or of 1 at 20 %."""
    return ((saving >= 10) & (pct >= 10)) | ((saving >= 1) & (pct >= 20))


def eligible_offers(offers: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Offers that may be shown: relevant, fresh, of a safe link and a saving worth having that the stored percentage states within 0.2."""
    day = F.lit(today).cast("date")
    saving = F.col("was") - F.col("price")
    stated = saving / F.col("was") * 100
    age = F.date_diff(day, F.col("last_seen"))
    keep = (F.col("relevance") >= 3) & age.between(0, days) & urls.is_public_link(F.col("link")) & worth_having(saving, F.col("pct")) & (F.abs(stated - F.col("pct")) <= 0.2)
    return offers.where(F.coalesce(keep, F.lit(False)))


def offer_reason(today: str) -> Column:
    """The first rule that an offer breaks."""
    saving = F.col("was") - F.col("price")
    return first_reason(
        ("no_price", F.col("price").isNull() | (F.col("price") <= 0)),
        ("price_not_lower", F.col("price") >= F.col("was")),
        ("bad_link", ~urls.is_public_link(F.col("link"))),
        ("not_relevant", F.col("relevance") < 2),
        ("future", F.col("last_seen") > F.lit(today).cast("date")),
        ("small_saving", ~worth_having(saving, F.col("pct"))),
    )


def offer_score(today: str) -> Column:
    """Ten points a step of relevance, ten less a day for freshness, savings capped at 40 points."""
    age = F.date_diff(F.lit(today).cast("date"), F.col("last_seen"))
    return F.col("relevance") * 10 + F.greatest(F.lit(0), 10 - age) + F.least(F.lit(40.0), F.col("pct"))


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n: reasons without what follows a colon, with the kept rows as 'kept'."""
    return rows.groupBy(F.coalesce(F.regexp_extract(reason, r"^[^:]*", 0), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))

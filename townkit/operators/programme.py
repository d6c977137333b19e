"""Which offers are of one kind: the key by which only the best of a kind is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townkit.functions.text import words_pattern

#: What an item's title must hold, by kind and in this order: words that follow each other, and for two parts both in turn.
ITEM_WORDS = (
    ("wipes", ("wipe", "wipes", "waterwipes")),
    ("nappy-bin-refills", ("nappy bin", "diaper bin"), ("refill", "refills", "cassette", "cassettes")),
    ("nappy-bins", ("nappy bin", "diaper bin")),
    ("rash-cream", ("rash cream", "healing cream", "barrier cream", "sudocrem")),
    ("nappies", ("nappies", "nappy", "diaper", "diapers")),
    ("pushchairs", ("pushchair", "pushchairs", "stroller", "strollers", "pram", "prams", "buggy", "buggies", "travel system")),
    ("booster-seats", ("booster seat", "booster seats", "booster car seat", "booster car seats", "high back booster seat", "high back booster seats", "high back booster car seat", "high back booster car seats")),
    ("car-seat-bases", ("car seat base", "isofix base")),
    ("car-seats", ("car seat", "car seats")),
    ("baby-monitors", ("baby monitor", "baby monitors")),
    ("travel-cots", ("travel cot", "travel cots")),
    ("cots-cribs", ("cot", "cots", "crib", "cribs", "co-sleeper", "co-sleepers", "co sleeper", "co sleepers", "cosleeper", "cosleepers")),
    ("baby-carriers", ("baby carrier", "baby carriers")),
    ("sterilisers", ("steriliser", "sterilisers", "sterilizer", "sterilizers")),
    ("safety-gates", ("stair gate", "stair gates", "safety gate", "safety gates", "baby gate", "baby gates")),
    ("play-gyms", ("play gym", "play gyms")),
    ("bath-bombs", ("bath bomb", "bath bombs")),
)
#: A benefit for families, and the terms that must stand with it.
BENEFITS = ("kid eat free", "kid go free", "kids eat free", "kids go free", "children eat free", "children go free", "2 for 1 tickets", "2 for 1 admission", "2 for 1 family tickets", "2 for 1 family admission")
CONDITIONS = ("with adult", "with a adult", "with an adult", "with paying adult", "with a paying adult", "with an paying adult", "per adult", "per paying adult", "adult meal", "adult ticket", "adult admission")
NUMBERED_CONDITIONS = r"\bage(?:d)? [0-9]+|\bunder [0-9]+|\bcode\s+[a-z0-9]+"


def item_pattern(*parts: tuple[str, ...]) -> str:
    return "(?i)" + ".*".join(map(words_pattern, parts))


def family_benefit(value: Column) -> Column:
    """The benefit that a text states together with its terms, else null."""
    benefit = F.regexp_extract(value, f"(?i){words_pattern(BENEFITS)}", 0)
    terms = value.rlike(f"(?i){words_pattern(CONDITIONS, ' ')}|{NUMBERED_CONDITIONS}")
    return F.when((benefit != "") & terms, benefit)


def plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def item_kind(value: Column, kinds=ITEM_WORDS) -> Column:
    return F.coalesce(*(F.when(value.rlike(item_pattern(*parts)), F.lit(name)) for name, *parts in kinds))


def item_key(kinds=ITEM_WORDS) -> Column:
    """The key of an offer, from its columns title, description, retailer, classified_by, item_id, equivalent_item_id, deal_type, matched_item, link.

    First that applies: a benefit for families (by retailer, and none where a merchant advertises), the taxonomy's item (services and
    holidays by their link), the kind that the title's words name, the kind of the matched item's, the matched item, the title without
    prices. Null and empty columns do not apply; a null title is an empty one.
    """
    title, matched = F.coalesce("title", F.lit("")), F.trim(F.coalesce("matched_item", F.lit("")))
    advertised = F.coalesce(F.col("classified_by").startswith("quality-v1:source-page:merchant-advertised:"), F.lit(False))
    benefit = F.when(~advertised, family_benefit(F.concat_ws(" ", title, F.coalesce("description", F.lit("")))))
    whose = F.lower(F.coalesce(F.nullif("retailer", F.lit("")), title))
    item = F.concat(F.lit("taxonomy:"), F.coalesce(F.nullif("equivalent_item_id", F.lit(0)), F.nullif("item_id", F.lit(0))).cast("string"))
    single = (F.col("deal_type") == "service") | F.col("matched_item").rlike(f"(?i){words_pattern(('holiday', 'holidays', 'vacation', 'vacations'))}")
    return F.coalesce(
        F.concat(F.lit("benefit:"), F.lower(benefit), F.lit(":"), whose),
        F.when(F.coalesce(F.col("item_id"), F.lit(0)) != 0, F.when(F.coalesce(single, F.lit(False)), F.concat_ws(":", item, "link")).otherwise(item)),
        F.concat(F.lit("item:"), item_kind(title, kinds)),
        F.when(matched != "", F.coalesce(F.concat(F.lit("item:"), item_kind(matched, kinds)), F.concat(F.lit("matched:"), plain(matched)))),
        F.concat(F.lit("title:"), plain(F.regexp_replace(F.lower(title), r"£\s*[0-9,.]+", ""))),
    )

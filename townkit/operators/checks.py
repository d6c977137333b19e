"""Checks with the first reason that holds: offers, places of news, categories; staged writes that count only once they are confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions.text import norm_text
from townkit.functions.urls import is_public_link

#: Names under which retailers appear, and what they are called.
RETAILERS = {"m&s": "marks and spencer", "marks & spencer": "marks and spencer", "marks and spencer": "marks and spencer", "amazon": "amazon", "argos": "argos", "halfords": "halfords", "ocado": "ocado", "tesco": "tesco", "asda": "asda"}
SOLD = r"(?i)\b(?:expired|sold out|out of stock|no longer available)\b"
STATED = rf"(?i)£\s*([\d,.]+)\s+(?:at|from)\s+({'|'.join(sorted(RETAILERS, key=len, reverse=True))})\b"


def offer_problem(now: Column, most_days: int = 45) -> Column:
    """Why an offer (title, link, retailer, description, price, status, starts, expires, posted, audience) is refused, the first reason; null if it is fine.

    Dates that cannot be read are 'invalid_offer_date'; null ones are no reason. An offer ends at its expiry and starts at its start.
    """
    names = F.create_map(*(F.lit(x) for pair in RETAILERS.items() for x in pair))
    known = lambda c: F.coalesce(F.try_element_at(names, c), c)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    head = F.substring(F.coalesce("description", F.lit("")), 1, 200)
    stated, claimed = F.regexp_extract(head, STATED, 2), known(norm_text(F.col("retailer")))
    amount = F.regexp_replace(F.regexp_extract(head, STATED, 1), ",", "").try_cast("double")
    conflict = (claimed != "") & (stated != "") & (amount == F.col("price")) & (known(F.lower(stated)) != claimed)
    read = {c: F.try_to_timestamp(c) for c in ("expires", "starts")}
    unreadable = lambda c: ~blank(F.col(c)) & read[c].isNull()
    return (
        F.when(F.coalesce("audience_invalid", F.lit(False)), "outside_audience").when(blank(F.col("title")), "missing_title").when(~is_public_link(F.col("link")), "bad_link").when(conflict, "merchant_conflict")
        .when(~blank(F.col("status")) & (F.col("status") != "active"), "source_unavailable").when(unreadable("expires"), "invalid_offer_date").when(read["expires"] <= now, "expired").when(unreadable("starts"), "invalid_offer_date")
        .when(read["starts"] > now, "not_started").when(F.col("title").rlike(SOLD), "source_unavailable").when(~F.col("price").between(0, 10_000), "implausible_price").when(F.col("posted") < now - F.make_interval(days=F.lit(most_days)), "too_old")
    )


def local_places(answers: DataFrame, districts: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, district, county, problem of answers (id, nation, locality, admin_area, title) against districts (district, county, nation) and aliases (alias, name).

    Names are slugs without a council's suffix, then their canonical name. A known district brings its county, if it has one; one that is not known is never widened to a county;
    without a locality, the area may be a district or a county of the nation. What is found must stand in the title under its name or an alias, else nothing counts.
    The two tables are gazetteers: lists of names, joined by key.
    """
    bare = lambda c: F.nullif(F.regexp_replace(F.replace(norm_text(F.col(c)), F.lit(" "), F.lit("_")), "_(county_council|district_council|borough_council|city_council|council)$", ""), F.lit(""))
    rows = answers.withColumns({"loc": bare("locality"), "adm": bare("admin_area")})
    for column in ("loc", "adm"):
        rows = rows.join(aliases.select(F.col("alias").alias(column), F.col("name").alias(f"{column}_name")), column, "left").withColumn(column, F.coalesce(f"{column}_name", column))
    for column in ("loc", "adm"):
        rows = rows.join(districts.select(F.col("district").alias(column), F.col("county").alias(f"{column}_county"), "nation", F.lit(True).alias(f"{column}_known")), [column, "nation"], "left")
    counties = districts.where("county IS NOT NULL").select(F.col("county").alias("adm"), "nation").distinct().withColumn("is_county", F.lit(True))
    rows = rows.join(counties, ["adm", "nation"], "left")
    as_county = F.when(F.col("is_county"), F.col("adm")).otherwise(F.col("adm_county"))
    district = F.when(F.col("loc_known"), F.col("loc")).when(F.col("loc").isNull() & F.col("adm_known"), F.col("adm"))
    county = F.when(F.col("loc_known"), F.col("loc_county")).when(F.col("loc").isNull(), as_county)
    rows = rows.withColumns({"found_district": district, "found_county": county}).withColumn("found", F.coalesce("found_district", "found_county"))
    others = aliases.groupBy(F.col("name").alias("found")).agg(F.collect_set("alias").alias("others"))
    rows = rows.join(others, "found", "left")
    hay = F.concat(F.lit("_"), F.replace(norm_text(F.col("title")), F.lit(" "), F.lit("_")), F.lit("_"))
    named = F.exists(F.concat(F.array("found"), F.coalesce("others", F.expr("cast(array() AS array<string>)"))), lambda n: F.contains(hay, F.concat(F.lit("_"), n, F.lit("_"))))
    problem = F.when(F.col("found").isNull(), "not recognised").when(~named, "not named in the text")
    keep = lambda c: F.when(problem.isNull(), F.col(c))
    return rows.select("id", keep("found_district").alias("district"), keep("found_county").alias("county"), problem.alias("problem"))


def category(title: Column, text: Column, stored: Column, rules: list[tuple[str, str]], stored_as: dict[str, str], default: str) -> Column:
    """The category that a stored one stands for, else of the first rule (category, pattern) that the title meets, else of the first that the text meets."""
    first = lambda c: [F.when(F.coalesce(c, F.lit("")).rlike(f"(?i){p}"), name) for name, p in rules]
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in stored_as.items() for x in pair)), stored)
    return F.coalesce(known, *first(title), *first(text), F.lit(default))


def editor_evidence(items: DataFrame, shown: DataFrame) -> DataFrame:
    """filter, n, n_shown: how many items (id, hidden, is_primary, relevance, url) each of the editor's filters finds, and how many of them are public (shown: id)."""
    rows = items.join(shown.select("id").distinct().withColumn("public", F.lit(1)), "id", "left")
    found = F.array(
        F.lit("all"), F.when(F.col("hidden"), "hidden"), F.when(~F.col("is_primary"), "duplicates"), F.when(F.col("relevance") < 3, "low-relevance"), F.when(F.coalesce("url", F.lit("")) == "", "missing-link"),
    )
    rows = rows.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("filter"), "public")
    return rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.count("public").alias("n_shown"))


def resolved_links(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """rows (id, at, url) with the address that a wrapped one leads to (resolved: url, target), the wrapped one itself where that is unknown or unsafe; at keeps the order."""
    best = resolved.where(F.col("target").rlike("(?i)^https?://[^/@]+(/|$)")).groupBy("url").agg(F.min("target").alias("target"))
    return rows.join(best, "url", "left").select("id", "at", F.coalesce("target", "url").alias("url"), F.col("target").isNotNull().alias("resolved"))


def committed(staged: DataFrame, persisted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) rows of a staged cache: those whose key was persisted, and the rest, which are to be read again."""
    keys = persisted.select(key).distinct()
    return staged.join(keys, key, "left_semi"), staged.join(keys, key, "left_anti")


def patched(snapshot: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """The snapshot with the patch's value (key, before, after) where the row still holds the value that the patch was made for; outcome: 'patched', 'conflict' or 'kept'."""
    rows = snapshot.join(patch.select(key, "before", "after", F.lit(True).alias("in_patch")), key, "left")
    same = F.col("in_patch") & F.col(column).eqNullSafe(F.col("before"))
    outcome = F.when(same, "patched").when(F.col("in_patch"), "conflict").otherwise("kept")
    return rows.withColumns({"outcome": outcome, column: F.when(same, F.col("after")).otherwise(F.col(column))}).select(*snapshot.columns, "outcome")

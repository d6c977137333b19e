"""Answers about where news belongs: checked against gazetteers and against what the item says, then attached to the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.functions.text import norm_text
from townkit.operators.checks import local_places

#: Nations, scopes and other names of scopes, and the warning of a batch whose answers do not fit its items.
NATIONS = ("uk", "england", "scotland", "wales", "northern_ireland")
SCOPES = ("nationwide", "regional", "local")
SCOPE_ALIASES = {"admin_area": "local", "county": "local", "district": "local"}
MISSING = "missing/duplicate/out-of-range article results"


def slug(value: Column) -> Column:
    return F.nullif(F.replace(norm_text(value), F.lit(" "), F.lit("_")), F.lit(""))


def evidence(title: Column, snippet: Column, source: Column) -> Column:
    """What an item says: title, snippet, and the source if it names a council."""
    council = F.when(source.rlike(r"(?i)\bcouncil\b"), source)
    return F.concat_ws(" ", title, snippet, council)


def attached(answers: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers with their items, one row a batch with the warning of those whose answers do not fit).

    answers: batch, place, i (the index that they state, as text) and others; items: batch, index and others. Of several answers of an
    index the first counts; answers without a number, or of no item, are left out. A batch is warned of if an item has no answer.
    """
    whole = F.when(F.col("i").rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim("i").cast("int"))
    others = [c for c in answers.columns if c not in ("batch", "i")]
    first = answers.withColumn("index", whole).where(F.col("index").isNotNull()).groupBy("batch", "index").agg(F.min_by(F.struct(*others), "place").alias("a"))
    met = items.join(first, ["batch", "index"], "left")
    warned = met.groupBy("batch").agg(F.count(F.lit(1)).alias("expected"), F.count("a").alias("received")).withColumn("warning", F.when(F.col("expected") != F.col("received"), MISSING))
    return met.where("a IS NOT NULL").select(*items.columns, *(F.col(f"a.{c}").alias(c) for c in others if c not in items.columns)), warned


def checked(rows: DataFrame, districts: DataFrame, aliases: DataFrame, regions: DataFrame) -> DataFrame:
    """id, problem, geo_scope, geo_region, admin_area, locality: the first rule that an answer breaks, and its geography if it breaks none.

    rows: id, title, snippet, source, region (the nation), geo_scope, geo_region, admin_area, locality; districts and aliases as
    checks.local_places takes them; regions: region, name (the region itself and its other names). Scopes of other names are local. A
    region, district or county must be one of the nation and be named in the item. Broken answers have no geography at all.
    """
    scope = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SCOPE_ALIASES.items() for x in pair)), F.col("geo_scope")), F.col("geo_scope"))
    rows = rows.withColumns({"scope": scope, "said": evidence(F.col("title"), F.col("snippet"), F.col("source")), "name": slug(F.col("geo_region"))})
    names = regions.groupBy("region").agg(F.collect_set("name").alias("names"))  # a region's few other names
    known = regions.join(names, "region").select("name", F.col("region").alias("known_region"), "names").dropDuplicates(["name"])
    rows = rows.join(known, "name", "left")
    hay = F.concat(F.lit("_"), F.coalesce(slug(F.col("said")), F.lit("")), F.lit("_"))
    region_named = F.exists("names", lambda n: hay.contains(F.concat(F.lit("_"), n, F.lit("_"))))
    places = local_places(rows.where("scope = 'local'").select("id", F.col("region").alias("nation"), "locality", "admin_area", F.col("said").alias("title")), districts, aliases).withColumnRenamed("problem", "place_problem")
    rows = rows.join(places, "id", "left")
    is_scope = lambda s: F.coalesce(F.col("scope") == s, F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("region").isin(*NATIONS), F.lit(False)), "missing/invalid nation").when(~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "missing/invalid geo_scope")
        .when(~is_scope("nationwide") & (F.col("region") == "uk"), "UK-wide nation conflicts with narrow scope")
        .when(is_scope("regional") & ((F.col("region") != "england") | F.col("known_region").isNull()), "unsupported/missing sub-national region").when(is_scope("regional") & ~F.coalesce(region_named, F.lit(False)), "regional scope without named region evidence")
        .when(is_scope("local") & (F.col("place_problem") == "not recognised"), "local scope without a recognised council/county in this nation").when(is_scope("local") & F.col("place_problem").isNotNull(), "local scope without named council/county evidence")
    )
    rows = rows.withColumn("found", problem)
    keep = lambda c: F.when(F.col("found").isNull(), F.col(c))
    return rows.select("id", F.col("found").alias("problem"), keep("scope").alias("geo_scope"), F.when(F.col("found").isNull() & (F.col("scope") == "regional"), F.col("known_region")).alias("geo_region"), keep("county").alias("admin_area"), keep("district").alias("locality"))

"""Discovered places: their postcodes, stated or nearest, and how they agree with the council."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.functions import places
from townkit.operators.joins import look_up
from townkit.operators.nearest import nearest_join


def resolve_postcodes(spots: DataFrame, postcodes: DataFrame, radius_km: float = 1.0) -> DataFrame:
    """spot, postcode, postcode_source, council_check, town, stored_postcode, km of every spot.

    spots: spot (unique), tagged (the postcode that the source states, or null), lat, lng, council (code). postcodes: postcode, lat, lng,
    district (code), town. A stated postcode is looked up by key; a spot without one gets the nearest postcode within the radius. A district
    that is not the council's is flagged, not dropped; what is found nowhere is `unavailable`. Councils whose code begins with N have no
    postcodes to look up: their spots keep what is stated. Only a stated postcode is stored: the nearest one is a hint. A null council
    agrees with no district; null coordinates find no postcode. Rows of one postcode are one: that with the least district.
    """
    known = postcodes.select(places.stated_postcode(F.col("postcode")).alias("code"), "postcode", "lat", "lng", "district", "town").where(F.col("code") != "")
    known = known.groupBy("code").agg(F.min(F.struct("district", "postcode", "lat", "lng", "town")).alias("p"))
    tag = places.stated_postcode(F.col("tagged"))
    rows = spots.select("spot", "lat", "lng", "council", F.when(tag != "", tag).alias("code"))
    foreign = F.coalesce(F.col("council").startswith("N"), F.lit(False))
    stated = look_up(rows.where(~foreign & F.col("code").isNotNull()), known, ["code"], "left").select("spot", "council", "code", F.lit("osm_tag").alias("source"), "p", F.lit(None).cast("double").alias("km"))
    untagged = rows.where(~foreign & F.col("code").isNull())
    near = nearest_join(untagged.withColumnRenamed("spot", "point"), known.select(F.col("code").alias("target"), "p.lat", "p.lng")).where(F.col("km") <= radius_km)
    near = untagged.select("spot", "council").join(near.select(F.col("point").alias("spot"), F.col("target").alias("code"), "km"), "spot", "left")
    guessed = look_up(near, known, ["code"], "left").select("spot", "council", "code", F.when(F.col("p").isNotNull(), "reverse_nearest").alias("source"), "p", "km")
    apart = rows.where(foreign).select("spot", "council", "code", F.when(F.col("code").isNotNull(), "osm_tag").alias("source"), F.lit(None).cast(known.schema["p"].dataType).alias("p"), F.lit(None).cast("double").alias("km"))
    every = stated.unionByName(guessed).unionByName(apart)
    other = F.col("p.district").isNotNull() & ~F.col("p.district").eqNullSafe(F.col("council"))
    check = F.when(F.coalesce(F.col("council").startswith("N"), F.lit(False)), "not_applicable_ni").when(F.col("p").isNull(), "unavailable").when(other, "postcode_other_council").otherwise("postcode_in_council")
    postcode = F.when(F.col("source") == "reverse_nearest", F.col("p.postcode")).otherwise(F.col("code"))
    return every.select("spot", postcode.alias("postcode"), F.col("source").alias("postcode_source"), check.alias("council_check"), F.when(check == "postcode_in_council", F.col("p.town")).alias("town"), F.when(F.col("source") == "osm_tag", F.col("code")).alias("stored_postcode"), "km")

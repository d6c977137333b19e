"""Adapters from providers' records to one shape, as tables of aliases; files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a raw offer, and under which names providers give them.
OFFER_ALIASES: dict[str, tuple[str, ...]] = {
    "record_id": ("id", "offerId", "promotionId", "dealId"),
    "title": ("title", "name", "label"),
    "description": ("description", "text", "body"),
    "link": ("url", "link", "deeplink"),
    "merchant": ("merchant", "advertiser", "store"),
    "price": ("price", "salePrice", "currentPrice"),
    "was": ("was", "rrp", "originalPrice"),
    "starts": ("startDate", "starts", "validFrom"),
    "expires": ("endDate", "expires", "validTo"),
}


def first_of(record: Column, *keys: str) -> Column:
    """The first key of a JSON record that is there and not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(record, f"$.{k}")), F.lit("")) for k in keys))


def adapt(records: DataFrame, source: str, json: str = "json", aliases: dict[str, tuple[str, ...]] = OFFER_ALIASES) -> DataFrame:
    """One row a record with the aliases' columns and its source."""
    return records.select(F.lit(source).alias("source"), *(first_of(F.col(json), *keys).alias(c) for c, keys in aliases.items()))


def unwrap(payloads: DataFrame, json: str = "json", keys: tuple[str, ...] = ("items", "results", "data", "features")) -> DataFrame:
    """A row for each record of a payload: an array, or an array under one of the keys. Geographic features give their properties with lng and lat."""
    listed = F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys), F.when(F.trim(F.col(json)).startswith("["), F.col(json)))
    rows = payloads.select(F.explode(F.from_json(listed, T.ArrayType(T.StringType()))).alias("record"))
    point = F.get_json_object("record", "$.geometry.coordinates")
    lng, lat = (F.from_json(point, "array<double>")[i] for i in (0, 1))
    return rows.select(F.coalesce(F.get_json_object("record", "$.properties"), F.col("record")).alias("json"), lng.alias("lng"), lat.alias("lat"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows by column name; columns that a source lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def complete_pages(pages: DataFrame, page: str = "page", signature: str = "signature", expected: str = "pages") -> DataFrame:
    """source, complete, reason of paged scans: all pages there, and none like another (a provider that repeats its last page)."""
    by = pages.groupBy("source").agg(F.count_distinct(page).alias("got"), F.max(expected).alias("want"), F.count_distinct(signature).alias("distinct"))
    reason = F.when(F.col("got") < F.col("want"), "missing_page").when(F.col("distinct") < F.col("got"), "repeated_page")
    return by.select("source", reason.isNull().alias("complete"), reason.alias("reason"))


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; raises if a required column is not in it."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, if there are at most so many; raises instead of giving a part."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def write_evidence(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def sitemap_entries(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """A line of XML for each row (loc, lastmod); raises beyond what one map may hold."""
    from townkit.functions.text import xml_escape

    line = F.concat(F.lit("<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    return bounded(rows, most).select(line.alias("xml"))

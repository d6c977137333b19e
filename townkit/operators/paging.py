"""Filters, ordering and pages of a directory: by radius, nearest first, by page with a count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townkit.functions import geo, text

MOST_ROWS = 48


def clamp_page(offset: int | None, limit: int | None, default: int = 24) -> tuple[int, int]:
    return max(0, offset or 0), max(1, min(MOST_ROWS, default if limit is None else limit))


def check_scope(radius_km: float, scope: str, lat: float | None, lng: float | None) -> None:
    """Raises on a radius outside (0, 100], NaN too, another scope than local or unknown, half a point, or unknown without a point."""
    if not 0 < radius_km <= 100:
        raise ValueError("the radius must be above 0 and at most 100 km")
    if scope not in ("local", "unknown"):
        raise ValueError("the scope is local or unknown")
    if (lat is None) != (lng is None):
        raise ValueError("a point needs both coordinates")
    if lat is not None and not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise ValueError("the point is not on the earth")
    if lat is None and scope != "local":
        raise ValueError("unknown distances need a point")


def directory_filter(venues: DataFrame, category: str | None = None, search: str | None = None, free: bool | None = None, searched: tuple[str, ...] = ("name", "category", "postcode")) -> DataFrame:
    """Visible venues with a name, of the category's slug, free or not, whose joined columns hold the search text."""
    keep = F.col("visible") & (F.trim(F.coalesce("name", F.lit(""))) != "")
    if category is not None:
        keep &= text.category_slug(F.col("category")) == category
    if free is not None:
        keep &= F.col("free").eqNullSafe(free)
    if search:
        keep &= text.contains_folded([F.col(c) for c in searched], search)
    return venues.where(keep)


def with_distance(venues: DataFrame, lat: float | None, lng: float | None) -> DataFrame:
    """km to the point; null without one, and for coordinates that are not on the earth."""
    if lat is None:
        return venues.withColumn("km", F.lit(None).cast("double"))
    usable = geo.valid_point(F.col("lat"), F.col("lng"))
    return venues.withColumn("km", F.when(usable, geo.haversine(lat, lng, F.col("lat"), F.col("lng"))))


def within_scope(rows: DataFrame, radius_km: float, scope: str, lat: float | None, lng: float | None) -> DataFrame:
    """local: up to the radius, with it; unknown: rows without a distance; no point: all rows."""
    check_scope(radius_km, scope, lat, lng)
    rows = with_distance(rows, lat, lng)
    if lat is None:
        return rows
    if scope == "unknown":
        return rows.where(F.col("km").isNull())
    found = geo.box(lat, lng, radius_km)  # columns in a range are pruned by file statistics; the circle decides
    near = rows if found is None else rows.where(geo.in_box(F.col("lat"), F.col("lng"), found))
    return near.where(F.col("km") <= radius_km)


def page(rows: DataFrame, order: list[Column], offset: int | None = None, limit: int | None = None) -> DataFrame:
    offset, limit = clamp_page(offset, limit)
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_total(rows: DataFrame, order: list[Column], offset: int | None, limit: int | None) -> DataFrame:
    """One row: `rows`, the page as JSON in order, and `total`, all rows before paging."""
    found = page(rows, order, offset, limit)
    at = Window.orderBy(*order)  # over a page only
    listed = found.select(F.struct(F.row_number().over(at).alias("n"), F.to_json(F.struct(*rows.columns)).alias("json")).alias("r"))
    listed = listed.agg(F.array_sort(F.collect_list("r")).alias("r")).select(F.concat(F.lit("["), F.array_join(F.col("r.json"), ","), F.lit("]")).alias("rows"))
    return listed.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row each


def has_more(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, bool]:
    """The first `limit` rows, and whether there are more, from one row too many."""
    probe = rows.orderBy(*order).limit(limit + 1)
    return rows.orderBy(*order).limit(limit), probe.count() > limit


def nearest(rows: DataFrame, lat: float, lng: float, k: int = 6) -> DataFrame:
    """The k nearest rows with coordinates, ties by name and id. A top-k by partition: no row but k of each partition is shuffled."""
    return with_distance(rows, lat, lng).where(F.col("km").isNotNull()).orderBy("km", "name", "id").limit(max(1, min(MOST_ROWS, k)))


def nearest_by(rows: DataFrame, group: str, lat: float, lng: float, k: int) -> DataFrame:
    """The k nearest rows of each group, with their place (n)."""
    order = Window.partitionBy(group).orderBy("km", "name", "id")
    return with_distance(rows, lat, lng).where(F.col("km").isNotNull()).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def in_order_of(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the given ids with their place in the list; ids without a row are absent."""
    wanted = F.array(*map(F.lit, ids))
    return rows.where(F.col("id").isin(*ids)).withColumn("place", F.array_position(wanted, F.col("id")))


def expanding_boxes(lat: float, lng: float, steps: tuple[float, ...] = (10, 40, 160, 640)) -> list[tuple[float, tuple[float, float, float, float]]]:
    """The radii that a nearest search may try first, each with its box; those that meet a pole or the date line are left out."""
    return [(km, b) for km in steps if (b := geo.box(lat, lng, km)) is not None and math.isfinite(b[0])]


def nearest_pruned(rows: DataFrame, lat: float, lng: float, k: int = 6) -> DataFrame:
    """As nearest, but looks in growing boxes first: a box is enough if it holds k rows within its radius."""
    for km, found in expanding_boxes(lat, lng):
        inside = with_distance(rows.where(geo.in_box(F.col("lat"), F.col("lng"), found)), lat, lng).where(F.col("km") <= km)
        top = inside.orderBy("km", "name", "id").limit(k)
        if top.count() == k:
            return top
    return nearest(rows, lat, lng, k)

"""Distances, coordinates, boxes and grid cells. Call sites differ in their constants on purpose."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diameters of the earth in km and miles, and the two factors between them that are in use.
KM_DIAMETER = 12742.0
MILES_DIAMETER = 7917.6
MILES_RADIUS = 3958.8
KM_A_MILE = 1.609344
MILES_A_KM = 0.621371
KM_A_DEGREE = 111.0
#: Degrees of latitude of a fine cell: over 200 m, so that what is that near lies in the cell or its neighbours.
FINE = 0.002


def number(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine(lat_a, lng_a, lat_b, lng_b, diameter: float = KM_DIAMETER) -> Column:
    """Great-circle distance, null if a coordinate is."""
    lat_a, lng_a, lat_b, lng_b = map(number, (lat_a, lng_a, lat_b, lng_b))
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lng_b - lng_a) / 2), 2)
    clamped = F.when(h.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), h)))
    return F.lit(diameter) * F.asin(F.sqrt(clamped))


def valid_point(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def box(lat: float, lng: float, km: float) -> tuple[float, float, float, float] | None:
    """(south, north, west, east) of a box that holds the circle; null where it meets a pole or the date line."""
    degrees = math.degrees(km / (KM_DIAMETER / 2))
    south, north = lat - degrees, lat + degrees
    if south <= -90 or north >= 90:
        return None
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(degrees)) / math.cos(math.radians(lat)))))
    west, east = lng - wide, lng + wide
    return None if west < -180 or east > 180 else (south, north, west, east)


def in_box(lat: Column, lng: Column, found: tuple[float, float, float, float]) -> Column:
    south, north, west, east = found
    return lat.between(south, north) & lng.between(west, east)


def cell(lat: Column, lng: Column, places: int = 2) -> Column:
    """Grid cell of a point, rounded half to even."""
    scale = 10**places
    return F.struct(F.bround(lat * scale).cast("long").alias("y"), F.bround(lng * scale).cast("long").alias("x"))


def cells_around(lat: Column, lng: Column, places: int = 2) -> Column:
    """The cell of a point and its eight neighbours."""
    own = cell(lat, lng, places)
    return F.array(*(F.struct((own["y"] + dy).alias("y"), (own["x"] + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))


def fine_cell(y: Column, lng: Column, dx: int = 0) -> Column:
    """The fine cell of row y: rows are parted by the length of their own degrees."""
    return F.struct(y.alias("y"), (F.floor(lng * F.cos(F.radians(y * FINE)) / FINE) + dx).alias("x"))


def fine_cells_around(lat: Column, lng: Column) -> Column:
    """The fine cell of a point and its eight neighbours."""
    row = F.floor(lat / FINE)
    return F.array(*(fine_cell(row + dy, lng, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))


def grid_point(value: Column, step: float = 0.25) -> Column:
    return F.round(value / step) * step


def box_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Area of a small box, by the length of a degree in its middle; 0 for a box that is none, or null."""
    area = (north - south) * KM_A_DEGREE * ((east - west) * KM_A_DEGREE * F.cos(F.radians((south + north) / 2)))
    return F.coalesce(F.greatest(F.lit(0.0), area), F.lit(0.0))

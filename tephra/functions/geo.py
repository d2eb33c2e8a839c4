"""Distances on a sphere and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tephra.config import Region

#: Fixed value: mean radius of the earth.
RADIUS_KM = 6371.0088
# Fixed value: kilometres of a degree of latitude, for cell sizes.
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def in_region(lon: Column, lat: Column, region: Region) -> Column:
    return lon.between(region.min_lon, region.max_lon) & lat.between(region.min_lat, region.max_lat)


def cell_diagonal_km(dlon: Column, dlat: Column, lat: Column) -> Column:
    """Length of a cell's diagonal at a latitude."""
    return F.hypot(dlat * KM_PER_DEGREE, dlon * KM_PER_DEGREE * F.cos(F.radians(lat)))


def ventilation(wind: Column, height: Column) -> Column:
    return wind * F.coalesce(height, F.lit(1.0))

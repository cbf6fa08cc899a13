"""Distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
BANDS_KM = (10, 50, 200, 500, 1000)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return F.when(known, 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() would pass over a null


def distance_band(km: Column) -> Column:
    """1 for up to 10 km, and so on; bands hold their upper end; the last is open."""
    out = F.when(km <= BANDS_KM[0], 1)
    for k, end in enumerate(BANDS_KM[1:], 2):
        out = out.when(km <= end, k)
    return out.otherwise(len(BANDS_KM) + 1)

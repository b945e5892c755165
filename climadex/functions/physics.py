"""Physical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AIR_DENSITY = 1.23
#: Mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0088
KELVIN = 273.15


def wind_power(u: Column, v: Column) -> Column:
    """Power density of a mean wind vector, W/m2."""
    return 0.5 * AIR_DENSITY * F.pow(F.sqrt(u * u + v * v), F.lit(3))


def celsius(kelvin: Column) -> Column:
    return kelvin - KELVIN


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

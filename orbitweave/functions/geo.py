"""Geometry on the earth as column expressions; degrees in, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def normalise_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def longitude_apart(a: Column, b: Column) -> Column:
    """Degrees between two longitudes the short way round."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360 - d)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle kilometres on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def year_days(ts: str) -> Column:
    """Days of a timestamp's year."""
    return F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))


def solar_zenith(day: Column, hour: Column, lat: Column, lon: Column, days: Column) -> Column:
    """Degrees between the sun and the vertical, by day of year, UTC hour and days of the year, with Spencer's Fourier series."""
    g = 2 * F.pi() / days * (day - 1 + (hour - 12) / 24)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    tilt = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((hour * 60 + equation + 4 * lon) / 4 - 180)
    height = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(angle)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height))))


def view_zenith(lat: Column, lon: Column, satellite_lon: float, height_m: float = 35_786_023.0, axis: float = 6_378_137.0, flattening: float = 1 / 298.257223563) -> Column:
    """Degrees between the vertical and the line of sight to a geostationary satellite, on the WGS-84 ellipsoid."""
    e2 = flattening * (2 - flattening)
    p, q = F.radians(lat), F.radians(lon)
    n = axis / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    x, y, z = n * F.cos(p) * F.cos(q), n * F.cos(p) * F.sin(q), n * (1 - e2) * F.sin(p)
    sx, sy = (axis + height_m) * F.cos(F.radians(F.lit(satellite_lon))), (axis + height_m) * F.sin(F.radians(F.lit(satellite_lon)))
    dx, dy, dz = sx - x, sy - y, -z
    up = dx * F.cos(p) * F.cos(q) + dy * F.cos(p) * F.sin(q) + dz * F.sin(p)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up / F.sqrt(dx * dx + dy * dy + dz * dz)))))

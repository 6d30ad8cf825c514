"""Calibration, scaling and classing of values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(x: Column, mean: Column, std: Column, least_std: float = 1e-6) -> Column:
    return (x - mean) / F.greatest(std, F.lit(least_std))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """To [0, 1], clipped; a range of zero counts as one, missing or NaN values become 0."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / span)))


def z_inverse(z: Column, mean: Column, std: Column, least_std: float = 1e-6) -> Column:
    return z * F.greatest(std, F.lit(least_std)) + mean


def min_max_inverse(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def min_max_eps(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """To [0, 1], clipped, with ``eps`` added to the range."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low + eps)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elevation(geopotential: Column) -> Column:
    """Metres, by standard gravity."""
    return geopotential / 9.80665


#: What the eastern and the western satellite see, in longitudes from -180 and from 0; and the latitudes.
EAST, EAST_LAT = (-147.4, -2.6022), 45.64
WEST, WEST_LAT = (150.425, 295.5748), 43.6826


def satellite_of(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Name ('None' where neither sees it), whether inside its latitudes, and longitude from -180, of a place with longitude from 0."""
    norm = F.when(lon > 180, lon - 360).otherwise(lon)
    east, west = norm.between(*EAST), lon.between(*WEST)
    east_in, west_in = east & lat.between(-EAST_LAT, EAST_LAT), west & lat.between(-WEST_LAT, WEST_LAT)
    name = F.when(east_in, "east").when(west_in, "west").when(east, "east").when(west, "west").otherwise("None")
    return name, east_in | west_in, norm


def reflectance(radiance: Column, sun_distance: float, irradiance: float) -> Column:
    """pi * d^2 / E of a visible radiance, clipped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), radiance * F.pi() * sun_distance**2 / irradiance))


def brightness_temperature(radiance: Column, fk1: float, fk2: float, bc1: float, bc2: float, floor: float = 1e-6) -> Column:
    """Inverse Planck of an emissive radiance, which counts as ``floor`` at least."""
    return (fk2 / F.log(fk1 / F.greatest(radiance, F.lit(floor)) + 1) - bc1) / bc2


def psnr(mse: Column, value_range: float) -> Column:
    return 10 * F.log10(value_range**2 / F.greatest(mse, F.lit(1e-12)))


def stage_class(x: Column, bins: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Column:
    """1 below the first bin, one more for each bin reached; 0 for missing, NaN and negative values."""
    steps = sum(((x >= b).cast("int") for b in bins), F.lit(1))
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0).otherwise(steps)


def height_tag(x: Column) -> Column:
    return F.when(x < 100, "surface").when(x < 5000, "low").otherwise("high")


def is_true(x: Column) -> Column:
    """Booleans, also written as text in any case with blanks around."""
    return F.lower(F.trim(x.cast("string"))) == "true"

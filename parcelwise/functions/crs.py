"""WGS84, UTM and spherical Mercator, as expressions: the Krüger series to the fourth order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
DEFAULT_EPSG = 32722

_N = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + utm_zone(lon)


def is_metric(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def _centre(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y) of WGS84 degrees in a UTM zone."""
    phi, lam = F.radians(lat), F.radians(lon - _centre(epsg))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))
    return F.struct((F.lit(SCALE * _A) * east + FALSE_EAST).alias("x"), (F.lit(SCALE * _A) * north + south).alias("y"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct(x, y): longitude and latitude of UTM metres."""
    south = F.when(epsg >= 32700, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))
    xi, eta = (y - south) / F.lit(SCALE * _A), (x - FALSE_EAST) / F.lit(SCALE * _A)
    north, east = xi, eta
    for j, b in enumerate(_BETA, 1):
        north = north - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # from the conformal latitude to the latitude: Newton's steps, each on a value that is bound once
    def newton(tau: Column, phi: Column) -> Column:
        sigma = F.sinh(F.lit(_E) * F.atanh(F.lit(_E) * phi / F.sqrt(1 + phi * phi)))
        now = phi * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + phi * phi)
        return phi + (tau - now) / F.sqrt(1 + now * now) * (1 + F.lit(1 - _E**2) * phi * phi) / (F.lit(1 - _E**2) * F.sqrt(1 + phi * phi))

    def degrees(p: Column) -> Column:
        target = F.sin(p["north"]) / F.cosh(p["east"])
        tau = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(4)), t, lambda phi, _: newton(t, phi))
        phi = F.get(F.transform(F.array(target / F.sqrt(1 - target * target)), tau), F.lit(0))
        return F.struct((_centre(epsg) + F.degrees(F.atan2(F.sinh(p["east"]), F.cos(p["north"])))).alias("x"), F.degrees(F.atan(phi)).alias("y"))

    return F.get(F.transform(F.array(F.struct(north.alias("north"), east.alias("east"))), degrees), F.lit(0))


def from_mercator(x: Column, y: Column) -> Column:
    """struct(x, y): longitude and latitude of spherical Mercator (EPSG:3857) metres."""
    return F.struct(F.degrees(x / AXIS).alias("x"), F.degrees(2 * F.atan(F.exp(y / AXIS)) - math.pi / 2).alias("y"))


def holds(epsg: Column, x0: Column, y0: Column, x1: Column, y1: Column, tolerance: float = 1e-9) -> Column:
    """Whether a zone's area of use (its 6° band, on its side of the equator) holds an extent."""
    west = _centre(epsg) - 3
    low, high = F.when(epsg >= 32700, F.lit(-80.0)).otherwise(F.lit(0.0)), F.when(epsg >= 32700, F.lit(0.0)).otherwise(F.lit(84.0))
    return (x0 >= west - tolerance) & (x1 <= west + 6 + tolerance) & (y0 >= low - tolerance) & (y1 <= high + tolerance)


def select_epsg(x0: Column, y0: Column, x1: Column, y1: Column, preferred: int = DEFAULT_EPSG) -> Column:
    """The zone of an extent in degrees: the preferred one if it holds it whole, else the centre's; null if none does."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    fine = x0.between(-180, 180) & x1.between(-180, 180) & y0.between(-90, 90) & y1.between(-90, 90)
    return F.when(fine & holds(F.lit(preferred), x0, y0, x1, y1), F.lit(preferred)).when(fine & holds(utm_epsg(cx, cy), x0, y0, x1, y1), utm_epsg(cx, cy))

"""Positions: transverse Mercator eastings and northings to longitude and latitude, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the scale and false origin of UTM.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0


def utm_lon_lat(east: Column, north: Column, zone: int, southern: bool = False, digits: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, rounded half to even, of a position in UTM zone `zone`, by Krüger's
    series to the third power of the ellipsoid's third flattening.  Null in, null out."""
    if not 1 <= zone <= 60:
        raise ValueError(f"no UTM zone {zone}")
    n = FLATTENING / (2 - FLATTENING)
    radius = SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (north - (SOUTH if southern else 0.0)) / radius, (east - EAST) / radius
    x, y = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    lon = F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (6 * zone - 183)
    return F.bround(lon, digits), F.bround(F.degrees(lat), digits)


def lon_lat(x: Column, y: Column, affine: tuple[float, float, float, float, float, float], epsg: int, digits: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a pixel of a raster in degrees (EPSG 4326) or in a UTM zone of
    WGS 84 (326.. north, 327.. south)."""
    a, b, c, d, e, f = affine
    east, north = a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f
    if epsg == 4326:
        return F.bround(east, digits), F.bround(north, digits)
    if epsg // 100 not in (326, 327):
        raise ValueError(f"EPSG {epsg} is not supported")
    return utm_lon_lat(east, north, epsg % 100, epsg // 100 == 327, digits)

"""Positions against the meridian's length by quadrature and against the forward projection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import geo


def forward(lon: float, lat: float, zone: int, southern: bool) -> tuple[float, float]:
    """The conformal latitude in closed form, then the forward series."""
    f, p, dl = geo.FLATTENING, np.radians(lat), np.radians(lon - (6 * zone - 183))
    n, e = f / (2 - f), np.sqrt(f * (2 - f))
    t = np.sinh(np.arctanh(np.sin(p)) - e * np.arctanh(e * np.sin(p)))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arctanh(np.sin(dl) / np.sqrt(1 + t * t))
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    r = geo.SCALE * geo.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    x = xi + sum(c * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, c in enumerate(a, 1))
    y = eta + sum(c * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, c in enumerate(a, 1))
    return float(geo.EAST + r * y), float(r * x + (geo.SOUTH if southern else 0))


def of(spark, points, zone, southern=False):
    lon, lat = geo.utm_lon_lat(F.col("e"), F.col("n"), zone, southern)
    return [tuple(r) for r in spark.createDataFrame(points, "e double, n double").coalesce(1).select(lon, lat).collect()]


def test_meridian(spark):
    p = np.radians(np.linspace(0, 45, 200001))
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    arc = np.trapezoid(geo.AXIS * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5, p)
    assert of(spark, [(500000.0, float(0.9996 * arc)), (None, 1.0)], 32) == [(9.0, 45.0), (None, None)]


@pytest.mark.parametrize("southern", [False, True])
def test_round_trip(spark, southern):
    sign = -1 if southern else 1
    want = [(7.25, sign * 46.5), (11.9, sign * 60.25), (6.1, sign * 3.5)]
    assert of(spark, [forward(*w, 32, southern) for w in want], 32, southern) == want


def test_zone():
    with pytest.raises(ValueError):
        geo.utm_lon_lat(F.col, F.col, 61)

"""Projections that are built in: web Mercator and transverse Mercator zones; everything else is refused."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import require

# The ellipsoid, the scale on the central meridian, the false easting, units in metres.
A, FLATTENING, K0, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
UNITS = {"metre": 1.0, "foot": 0.3048, "us_survey_foot": 1200 / 3937}


@dataclass(frozen=True)
class Frame:
    """Where lengths are measured; factor turns its units into metres (areas take its square)."""

    name: str
    factor: float = 1.0


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * A


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def utm_zone(xmin: float, ymin: float, xmax: float, ymax: float) -> int:
    """The zone that holds an extent in degrees; extents over several zones, over 6 by 8 degrees or near the poles are refused."""
    require(xmax - xmin <= 6 and ymax - ymin <= 8 and ymin >= -80 and ymax <= 84, "the extent is too large for a local frame")
    a, b = int((xmin + 180) // 6), int((min(xmax, 179.999999) + 180) // 6)
    require(a == b, "the extent lies in several zones")
    return a + 1


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the third order, good to a millimetre within a zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + K0 * radius * east, K0 * radius * north + (10_000_000.0 if south else 0.0)


def affine(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    return a * x + b * y + c, d * x + e * y + f

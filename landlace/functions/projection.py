"""Map projections as column expressions: transverse Mercator by Krueger's series, Lambert's conic, tiles.

The series run to the fourth order in the third flattening, which is exact to well under a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84, and the scale and false easting of UTM.
A, FLAT, K0, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
E2 = FLAT * (2 - FLAT)
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Krueger's coefficients, forward, back, and from conformal to geographic latitude.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def zone_of(lon: Column) -> Column:
    """UTM zone of a longitude in degrees."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def _central(zone: Column | int) -> Column:
    return F.radians((F.lit(zone) if isinstance(zone, int) else zone) * 6 - 183.0)


def utm(lon: Column, lat: Column, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees; south of the equator northings are negative, without the false 10,000 km of southern zones.

    A latitude past 90 degrees goes on over the pole, down the opposite meridian. Tangents keep their places near the pole, where sines are all 1.
    """
    c, p, d = 2 * math.sqrt(N) / (1 + N), F.radians(lat), F.radians(lon) - _central(zone)
    side = F.signum(F.cos(p))
    u, v = F.tan(p) * side, F.sinh(c * F.atanh(c * F.sin(p)))
    t = u * F.sqrt(1 + v * v) - v * F.sqrt(1 + u * u)
    xi, eta = F.atan2(t, side * F.cos(d)), F.atanh(side * F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return EASTING + K0 * RECTIFYING * east, K0 * RECTIFYING * north


def from_utm(east: Column, north: Column, zone: Column | int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, within 180 and 90 of zero."""
    xi, eta = north / (K0 * RECTIFYING), (east - EASTING) / (K0 * RECTIFYING)
    x = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    y = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = F.atan2(F.sin(x), F.hypot(F.sinh(y), F.cos(x)))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    lon = F.degrees(_central(zone) + F.atan2(F.sinh(y), F.cos(x)))
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon), F.degrees(lat)


def apart(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Metres between two near places, each a longitude and a latitude in degrees; it holds at the poles, where longitudes say nothing."""
    at = lambda p: (F.cos(F.radians(p[1])) * F.cos(F.radians(p[0])), F.cos(F.radians(p[1])) * F.sin(F.radians(p[0])), F.sin(F.radians(p[1])))
    return A * F.sqrt(sum((u - v) * (u - v) for u, v in zip(at(a), at(b), strict=True)))


#: Fixed values of a national grid (EPSG:7755): origin, standard parallels, false origin.
GRID = {"lat0": 24.0, "lon0": 80.0, "lat1": 12.472955, "lat2": 35.1728044444444, "x0": 4_000_000.0, "y0": 4_000_000.0}


def _cone(g: dict) -> tuple[float, float, float]:
    e = math.sqrt(E2)
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(g[k]) for k in ("lat0", "lat1", "lat2"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, A * f * t(p0) ** n


def lambert(lon: Column, lat: Column, g: dict = GRID) -> tuple[Column, Column]:
    """Easting and northing on a conic grid with two standard parallels."""
    n, f, r0 = _cone(g)
    e, p = math.sqrt(E2), F.radians(lat)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    r, th = A * f * F.pow(t, F.lit(n)), n * (F.radians(lon) - math.radians(g["lon0"]))
    return g["x0"] + r * F.sin(th), g["y0"] + r0 - r * F.cos(th)


def from_lambert(x: Column, y: Column, g: dict = GRID) -> tuple[Column, Column]:
    n, f, r0 = _cone(g)
    e, dx, dy = math.sqrt(E2), x - g["x0"], r0 - (y - g["y0"])
    r = F.sqrt(dx * dx + dy * dy)
    t = F.pow(r / (A * f), F.lit(1 / n))
    p = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):
        p = math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
    return F.degrees(F.atan2(dx, dy) / n + math.radians(g["lon0"])), F.degrees(p)


def quadkey(lat: Column, lon: Column, z: int = 9) -> Column:
    """Name of the web map tile: bits of the column and row number, interleaved, as digits 0 to 3."""
    s = F.sin(F.radians(lat))
    x = F.floor((lon + 180) / 360 * 2**z).cast("int")
    y = F.floor((0.5 - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * 2**z).cast("int")
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(x, i) + 2 * bit(y, i)).cast("string") for i in range(z - 1, -1, -1)])

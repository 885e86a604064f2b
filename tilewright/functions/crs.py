"""Coordinate reference systems in closed form: degrees to and from transverse Mercator (all UTM zones), Lambert conformal conic, Albers, Lambert
azimuthal equal-area and Web Mercator. The same formulas serve Columns (``m`` is ``pyspark.sql.functions``) and numbers (``m`` is ``math``).

Geographic systems count as degrees of WGS 84, whatever their datum: modern ones agree within a metre or two, and no shift grids come with this library.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

R = 6378137.0
WGS84, GRS80 = (R, 298.257223563), (R, 298.257222101)

# EPSG codes of geographic systems in degrees.
GEOGRAPHIC = (4326, 4267, 4269, 4258, 4171, 4283, 7844, 4167, 4617, 4759, 6318, 4674, 4612, 6668, 4490, 4152, 4979)
MERCATOR = (3857, 900913, 102100, 102113)


@dataclass(frozen=True)
class Degrees:
    pass


@dataclass(frozen=True)
class WebMercator:
    pass


@dataclass(frozen=True)
class Projection:
    """``kind``: ``tm``, ``lcc``, ``aea`` or ``laea``. Angles are degrees, lengths metres, ``unit`` metres a unit of the coordinates."""

    kind: str
    lat0: float
    lon0: float
    lat1: float = 0.0
    lat2: float = 0.0
    east: float = 0.0
    north: float = 0.0
    scale: float = 1.0
    ellipsoid: tuple[float, float] = GRS80
    unit: float = 1.0


# Parameters of common projected systems by EPSG (or ESRI) code.
PROJECTED = {
    5070: Projection("aea", 23.0, -96.0, 29.5, 45.5),
    6350: Projection("aea", 23.0, -96.0, 29.5, 45.5),
    102003: Projection("aea", 37.5, -96.0, 29.5, 45.5),
    3338: Projection("aea", 50.0, -154.0, 55.0, 65.0),
    3005: Projection("aea", 45.0, -126.0, 50.0, 58.5, 1e6, 0.0),
    3577: Projection("aea", 0.0, 132.0, -18.0, -36.0),
    2154: Projection("lcc", 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
    3034: Projection("lcc", 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0),
    3347: Projection("lcc", 63.390675, -91.86666666666666, 49.0, 77.0, 6200000.0, 3000000.0),
    3978: Projection("lcc", 49.0, -95.0, 49.0, 77.0),
    102004: Projection("lcc", 39.0, -96.0, 33.0, 45.0),
    3035: Projection("laea", 52.0, 10.0, east=4321000.0, north=3210000.0),
}
#: Blocks of codes of UTM zones: first code, first zone, number of zones, south, ellipsoid.
UTM = ((32601, 1, 60, False, WGS84), (32701, 1, 60, True, WGS84), (26901, 1, 23, False, GRS80), (25828, 28, 11, False, GRS80), (28348, 48, 11, True, GRS80), (7846, 46, 14, True, GRS80))


def utm(zone: int, south: bool, ellipsoid=WGS84) -> Projection:
    return Projection("tm", 0.0, 6.0 * zone - 183.0, east=500000.0, north=1e7 if south else 0.0, scale=0.9996, ellipsoid=ellipsoid)


def known(crs: str | int | None):
    """``EPSG:n``, ``OGC:CRS84`` or well-known text (``PROJCS[…]``, ``GEOGCS[…]``) as a system; None is degrees. Unknown ones are refused."""
    text = str(crs if crs is not None else "EPSG:4326").strip()
    if text.upper().startswith(("PROJCS", "GEOGCS")):
        return from_wkt(text)
    found = re.fullmatch(r"(?:(?:EPSG|ESRI|OGC):)?(CRS84|\d+)", text.upper())
    if found:
        code = 4326 if found[1] == "CRS84" else int(found[1])
        if code in GEOGRAPHIC:
            return Degrees()
        if code in MERCATOR:
            return WebMercator()
        if code in PROJECTED:
            return PROJECTED[code]
        for first, zone, n, south, ellipsoid in UTM:
            if first <= code < first + n:
                return utm(zone + code - first, south, ellipsoid)
    raise ValueError(f"unknown coordinate reference system {crs}; known are EPSG codes of degrees, Web Mercator, UTM zones and {sorted(PROJECTED)}, or WKT")


# Names that well-known text has for projections, in lower case, by kind.
_NAMES = {"transverse_mercator": "tm", "lambert_conformal_conic": "lcc", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "albers": "aea", "albers_conic_equal_area": "aea", "lambert_azimuthal_equal_area": "laea"}


def from_wkt(text: str):
    """The system that a ``.prj`` file names."""
    if text.upper().startswith("GEOGCS"):
        return Degrees()
    if "Pseudo-Mercator" in text or "Mercator_Auxiliary_Sphere" in text:
        return WebMercator()
    kind = _NAMES.get((re.search(r'PROJECTION\["([^"]+)"', text) or ["", ""])[1].lower())
    ball = re.search(r'SPHEROID\["[^"]*",\s*([\d.eE+]+),\s*([\d.eE+]+)', text)
    if kind is None or ball is None:
        raise ValueError(f"unknown projection in {text[:80]}")
    p = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+\d.eE]+)\]', text)}
    first = lambda *names, default=0.0: next((p[n] for n in names if n in p), default)
    unit = float((re.findall(r'UNIT\["[^"]*",\s*([\d.eE+-]+)', text.rsplit("PARAMETER", 1)[-1]) or ["1"])[-1])
    lat0 = first("latitude_of_origin", "latitude_of_center")
    lat1 = first("standard_parallel_1", default=lat0)
    return Projection(
        kind, lat0, first("central_meridian", "longitude_of_center", "longitude_of_origin"), lat1, first("standard_parallel_2", default=lat1),
        first("false_easting") * unit, first("false_northing") * unit, first("scale_factor", default=1.0), (float(ball[1]), float(ball[2])), unit,
    )


def _series(angle, coefficients, m, f: str = "sin"):
    return sum(getattr(m, f)(2.0 * k * angle) * c for k, c in enumerate(coefficients, 1))


@lru_cache
def _shape(ellipsoid):
    """Third flattening, eccentricity, and the series from conformal and authalic latitude to latitude."""
    f = 1 / ellipsoid[1]
    n, e2 = f / (2 - f), f * (2 - f)
    conformal = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    authalic = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    return n, math.sqrt(e2), conformal, authalic


def _m(phi: float, e: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _t(phi, e: float, m):
    s = e * m.sin(phi)
    return m.tan(math.pi / 4 - phi / 2.0) / m.pow((1.0 - s) / (1.0 + s), e / 2)


def _q(phi, e: float, m):
    s = e * m.sin(phi)
    return (m.sin(phi) / (1.0 - s * s) - m.log((1.0 - s) / (1.0 + s)) / (2 * e)) * (1 - e * e)


@lru_cache
def _cone(p: Projection) -> tuple[float, float, float]:
    """Cone constant, scale and radius of the origin of ``lcc`` and ``aea``."""
    a, (_, e, _, _) = p.ellipsoid[0], _shape(p.ellipsoid)
    one, two, origin = (math.radians(v) for v in (p.lat1, p.lat2, p.lat0))
    if p.kind == "lcc":
        t1, t2 = _t(one, e, math), _t(two, e, math)
        n = math.sin(one) if abs(one - two) < 1e-10 else math.log(_m(one, e) / _m(two, e)) / math.log(t1 / t2)
        size = p.scale * a * _m(one, e) / (n * t1**n)
        return n, size, size * _t(origin, e, math) ** n
    q1, q2 = _q(one, e, math), _q(two, e, math)
    n = math.sin(one) if abs(one - two) < 1e-10 else (_m(one, e) ** 2 - _m(two, e) ** 2) / (q2 - q1)
    size = _m(one, e) ** 2 + n * q1
    return n, size, a * math.sqrt(size - n * _q(origin, e, math)) / n


def _rectified(p: Projection) -> tuple[float, float]:
    """Radius of ``tm``, and northing of its origin latitude."""
    n = _shape(p.ellipsoid)[0]
    radius = p.scale * p.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, 0.0 if p.lat0 == 0 else radius * _tm_forward(math.radians(p.lat0), 0.0, n, math)[1]


def _tm_forward(phi, lam, n: float, m):
    """Easting and northing in units of the rectifying radius."""
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    k = 2 * math.sqrt(n) / (1 + n)
    t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * k) * k)
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1.0))
    east = eta + sum(m.cos(2.0 * j * xi) * m.sinh(2.0 * j * eta) * c for j, c in enumerate(alpha, 1))
    north = xi + sum(m.sin(2.0 * j * xi) * m.cosh(2.0 * j * eta) * c for j, c in enumerate(alpha, 1))
    return east, north


def to_degrees(x, y, crs, m=math):
    """Longitude and latitude in degrees of ``x``, ``y`` in ``crs``."""
    if isinstance(crs, Degrees):
        return x, y
    if isinstance(crs, WebMercator):
        return m.degrees(x / R), m.degrees(m.atan(m.sinh(y / R)))
    a, (n3, e, conformal, authalic) = crs.ellipsoid[0], _shape(crs.ellipsoid)
    x, y = x * crs.unit - crs.east, y * crs.unit - crs.north
    if crs.kind == "tm":
        beta = (
            n3 / 2 - 2 * n3**2 / 3 + 37 * n3**3 / 96 - n3**4 / 360,
            n3**2 / 48 + n3**3 / 15 - 437 * n3**4 / 1440,
            17 * n3**3 / 480 - 37 * n3**4 / 840,
            4397 * n3**4 / 161280,
        )
        radius, origin = _rectified(crs)
        xi, eta = (y + origin) / radius, x / radius
        up = xi - sum(m.sin(2.0 * j * xi) * m.cosh(2.0 * j * eta) * c for j, c in enumerate(beta, 1))
        right = eta - sum(m.cos(2.0 * j * xi) * m.sinh(2.0 * j * eta) * c for j, c in enumerate(beta, 1))
        chi = m.asin(m.sin(up) / m.cosh(right))
        phi, lam = chi + _series(chi, conformal, m), m.atan2(m.sinh(right), m.cos(up))
    elif crs.kind in ("lcc", "aea"):
        n, size, origin = _cone(crs)
        sign = 1.0 if n > 0 else -1.0
        rho = m.sqrt(x * x + (y * -1.0 + origin) * (y * -1.0 + origin))
        lam = m.atan2(x * sign, (y * -1.0 + origin) * sign) / n
        if crs.kind == "lcc":
            chi = m.atan(m.pow(rho * (sign / size), 1 / n)) * -2.0 + math.pi / 2
            phi = chi + _series(chi, conformal, m)
        else:
            beta = m.asin((rho * rho * (-(n * n) / (a * a)) + size) / n / _q(math.pi / 2, e, math))
            phi = beta + _series(beta, authalic, m)
    else:
        pole, origin = _q(math.pi / 2, e, math), math.radians(crs.lat0)
        first, ball = math.asin(_q(origin, e, math) / pole), a * math.sqrt(pole / 2)
        d = a * _m(origin, e) / (ball * math.cos(first))
        rho = m.sqrt(x * x / (d * d) + y * y * (d * d)) + 1e-12
        c = m.asin(rho / (2 * ball)) * 2.0
        beta = m.asin(m.cos(c) * math.sin(first) + y * m.sin(c) / rho * (d * math.cos(first)))
        lam = m.atan2(x * m.sin(c), rho * m.cos(c) * (d * math.cos(first)) - y * m.sin(c) * (d * d * math.sin(first)))
        phi = beta + _series(beta, authalic, m)
    return m.degrees(lam) + crs.lon0, m.degrees(phi)


def from_degrees(lon, lat, crs, m=math):
    """``x``, ``y`` in ``crs`` of longitude and latitude."""
    if isinstance(crs, Degrees):
        return lon, lat
    if isinstance(crs, WebMercator):
        return m.radians(lon) * R, m.asinh(m.tan(m.radians(lat))) * R
    a, (n3, e, _, _) = crs.ellipsoid[0], _shape(crs.ellipsoid)
    phi, lam = m.radians(lat), m.radians(lon - crs.lon0)
    if crs.kind == "tm":
        radius, origin = _rectified(crs)
        x, y = _tm_forward(phi, lam, n3, m)
        x, y = x * radius, y * radius - origin
    elif crs.kind in ("lcc", "aea"):
        n, size, origin = _cone(crs)
        rho = m.pow(_t(phi, e, m), n) * size if crs.kind == "lcc" else m.sqrt(_q(phi, e, m) * -n + size) * (a / n)
        x, y = rho * m.sin(lam * n), rho * m.cos(lam * n) * -1.0 + origin
    else:
        pole, origin = _q(math.pi / 2, e, math), math.radians(crs.lat0)
        first, ball = math.asin(_q(origin, e, math) / pole), a * math.sqrt(pole / 2)
        d = a * _m(origin, e) / (ball * math.cos(first))
        beta = m.asin(_q(phi, e, m) / pole)
        b = m.sqrt(2.0 / (m.sin(beta) * math.sin(first) + m.cos(beta) * m.cos(lam) * math.cos(first) + 1.0)) * ball
        x = b * m.cos(beta) * m.sin(lam) * d
        y = b * (m.sin(beta) * math.cos(first) - m.cos(beta) * m.cos(lam) * math.sin(first)) / d
    return (x + crs.east) / crs.unit, (y + crs.north) / crs.unit


def transform_point(x: float, y: float, source, target) -> tuple[float, float]:
    return from_degrees(*to_degrees(x, y, source), target)


"""Inverse map projections as column expressions: easting and northing in metres to degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Half axis in metres and flattening."""

    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


#: Published ellipsoids.
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
BESSEL = Ellipsoid(6377397.155, 1 / 299.1528128)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _settled(start: Column, step, rounds: int) -> Column:
    """A fixed-point iteration of ``rounds`` steps."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: step(x))


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of a transverse Mercator grid."""

    lon0: float
    k0: float
    east0: float
    north0: float
    lat0: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Krueger's series to the fourth order."""
        n = self.ellipsoid.f / (2 - self.ellipsoid.f)
        radius = self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        delta = (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )
        xi = (north - self.north0 + self._arc(n, radius)) / (self.k0 * radius)
        eta = (east - self.east0) / (self.k0 * radius)
        xi1, eta1 = xi, eta
        for j, b in enumerate(beta, 1):
            xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        lat = chi
        for j, d in enumerate(delta, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return F.degrees(lat), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + self.lon0

    def _arc(self, n: float, radius: float) -> float:
        """Scaled meridian arc up to the grid's latitude of origin."""
        if not self.lat0:
            return 0.0
        e = math.sqrt(self.ellipsoid.e2)
        p = math.radians(self.lat0)
        t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
        xi = math.atan(t)
        alpha = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        return self.k0 * radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


@dataclass(frozen=True)
class LambertConic:
    """Parameters of a Lambert conformal conic grid with two standard parallels."""

    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east0: float
    north0: float
    ellipsoid: Ellipsoid = GRS80

    def _t(self, lat: float) -> float:
        e = math.sqrt(self.ellipsoid.e2)
        s = math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - self.ellipsoid.e2 * math.sin(lat) ** 2)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Closed form but for the latitude, which six fixed-point steps settle to far below a millimetre."""
        p0, p1, p2 = (math.radians(x) for x in (self.lat0, self.lat1, self.lat2))
        e = math.sqrt(self.ellipsoid.e2)
        n = (math.log(self._m(p1)) - math.log(self._m(p2))) / (math.log(self._t(p1)) - math.log(self._t(p2)))
        scale = self._m(p1) / (n * self._t(p1) ** n)
        r0 = self.ellipsoid.a * scale * self._t(p0) ** n
        x, y = east - self.east0, F.lit(r0) - (north - self.north0)
        t = F.pow(F.sqrt(x * x + y * y) / (self.ellipsoid.a * scale), F.lit(1 / n))
        step = lambda k, p: math.pi / 2 - 2 * F.atan(k * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
        lat = _let(t, lambda k: _settled(math.pi / 2 - 2 * F.atan(k), lambda p: step(k, p), 6))
        return F.degrees(lat), F.degrees(F.atan2(x, y) / n) + self.lon0


#: National grids.
UTM32 = TransverseMercator(9.0, 0.9996, 500000.0, 0.0)
UTM33 = TransverseMercator(15.0, 0.9996, 500000.0, 0.0)
SWEREF99TM = UTM33
PUWG92 = TransverseMercator(19.0, 0.9993, 500000.0, -5300000.0)
LKS94 = TransverseMercator(24.0, 0.9998, 500000.0, 0.0)
LKS92 = TransverseMercator(24.0, 0.9996, 500000.0, -6000000.0)
MGI_M28 = TransverseMercator(10 + 1 / 3, 1.0, 150000.0, -5000000.0, ellipsoid=BESSEL)
MGI_M31 = TransverseMercator(13 + 1 / 3, 1.0, 450000.0, -5000000.0, ellipsoid=BESSEL)
MGI_M34 = TransverseMercator(16 + 1 / 3, 1.0, 750000.0, -5000000.0, ellipsoid=BESSEL)
LAMBERT93 = LambertConic(46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0)
LEST97 = LambertConic(57.517553930555555, 24.0, 59.0 + 1 / 3, 58.0, 500000.0, 6375000.0)


def shifted_datum(lat: Column, lon: Column, dx: float, dy: float, dz: float, source: Ellipsoid = BESSEL, target: Ellipsoid = GRS80) -> tuple[Column, Column]:
    """Abridged Molodensky shift of degrees from one ellipsoid to another."""
    da, df = target.a - source.a, target.f - source.f

    def moved(at: Column) -> Column:
        p, l = F.radians(at["lat"]), F.radians(at["lon"])
        s, c = F.sin(p), F.cos(p)
        w = 1 - source.e2 * s * s
        m = source.a * (1 - source.e2) / F.pow(w, F.lit(1.5))
        nu = source.a / F.sqrt(w)
        dp = (-dx * s * F.cos(l) - dy * s * F.sin(l) + dz * c + (source.a * df + source.f * da) * F.sin(2 * p)) / m
        dl = (-dx * F.sin(l) + dy * F.cos(l)) / (nu * c)
        return F.struct((at["lat"] + F.degrees(dp)).alias("lat"), (at["lon"] + F.degrees(dl)).alias("lon"))

    out = _let(F.struct(lat.alias("lat"), lon.alias("lon")), moved)
    return out["lat"], out["lon"]


#: Austria's shift to WGS 84, in metres.
MGI_SHIFT = (577.326, 90.129, 463.919)


def mgi(grid: TransverseMercator, east: Column, north: Column) -> tuple[Column, Column]:
    """Austrian grids to WGS 84."""
    return shifted_datum(*grid.inverse(east, north), *MGI_SHIFT)


def lv95(east: Column, north: Column) -> tuple[Column, Column]:
    """Swiss grid to WGS 84 by the survey's published approximation (about a metre)."""
    y, x = (east - 2600000) / 1000000, (north - 1200000) / 1000000
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lat * 100 / 36, lon * 100 / 36


def krovak(y: Column, x: Column) -> tuple[Column, Column]:
    """Czech S-JTSK (positive westing y, southing x) to WGS 84: oblique conic on Bessel, then a shift."""
    a, e = BESSEL.a, math.sqrt(BESSEL.e2)
    phi0, uq, s0 = math.radians(49.5), math.radians(59 + 42 / 60 + 42.69689 / 3600), math.radians(78.5)
    lon0, k1 = math.radians(24 + 50 / 60), 0.9999
    alpha = math.sqrt(1 + e * e / (1 - e * e) * math.cos(phi0) ** 4)
    u0 = math.asin(math.sin(phi0) / alpha)
    g = ((1 + e * math.sin(phi0)) / (1 - e * math.sin(phi0))) ** (alpha * e / 2)
    k = math.tan(u0 / 2 + math.pi / 4) / math.tan(phi0 / 2 + math.pi / 4) ** alpha * g
    n0 = a * math.sqrt(1 - e * e) / (1 - e * e * math.sin(phi0) ** 2)
    n = math.sin(s0)
    rho0 = k1 * n0 / math.tan(s0)
    rho, eps = F.sqrt(x * x + y * y), F.atan2(y, x)
    d = eps / n
    s = 2 * (F.atan(F.pow(F.lit(rho0) / rho, F.lit(1 / n)) * math.tan(s0 / 2 + math.pi / 4)) - math.pi / 4)
    u = F.asin(math.sin(uq) * F.sin(s) - math.cos(uq) * F.cos(s) * F.cos(d))
    dv = F.asin(F.cos(s) * F.sin(d) / F.cos(u))
    lon = F.lit(lon0) - dv / alpha
    base = F.pow(F.tan(u / 2 + math.pi / 4), F.lit(1 / alpha)) * k ** (-1 / alpha)
    step = lambda b, p: 2 * (F.atan(b * F.pow((1 + e * F.sin(p)) / (1 - e * F.sin(p)), F.lit(e / 2))) - math.pi / 4)
    lat = _let(base, lambda b: _settled(2 * (F.atan(b) - math.pi / 4), lambda p: step(b, p), 5))
    return shifted_datum(F.degrees(lat), F.degrees(lon), 570.8, 85.7, 462.8)

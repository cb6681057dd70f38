"""Map projections both ways as column expressions: transverse Mercator, Lambert's conic, web Mercator, plain degrees.

Constants of a projection are worked out once; a point takes one expression without
loops: the latitude comes from its conformal latitude by a series in the third
flattening, whose next term is far below a micrometre. Datums on the same ellipsoid to
a metre (NAD83 and WGS84) are taken as one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import affine, from_mercator, to_mercator

#: Half axis in metres and inverse flattening.
GRS80, WGS84, CLARKE_1866, AIRY = (6378137.0, 298.257222101), (6378137.0, 298.257223563), (6378206.4, 294.978698214), (6377563.396, 299.3249646)
US_FOOT = 1200 / 3937


def _series(n: float, rows: list[list[float]]) -> list[float]:
    """Coefficients of sin(2 j v): row j lists the factors of n^j, n^(j + 1)... up to n^6."""
    return [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


# Krüger's series, from the sphere to the plane, back, and from the conformal to the geodetic latitude.
TO_PLANE = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
FROM_PLANE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]
TO_GEODETIC = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [4279 / 630, -332 / 35, -399572 / 14175],
    [4174 / 315, -144838 / 6237],
    [601676 / 22275],
]


def _third(ellipsoid: tuple[float, float]) -> tuple[float, float]:
    """Third flattening and eccentricity."""
    f = 1 / ellipsoid[1]
    return f / (2 - f), math.sqrt(f * (2 - f))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once: the series name it a dozen times, and nested they would outgrow a compiled method."""
    return F.transform(F.array(value), then)[0]


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _geodetic(chi: Column, ellipsoid: tuple[float, float]) -> Column:
    return _let(chi, lambda v: sum((F.sin(v * (2 * j)) * c for j, c in enumerate(_series(_third(ellipsoid)[0], TO_GEODETIC), 1)), v))


@dataclass(frozen=True)
class TransverseMercator:
    """Degrees to easting and northing, in units of `unit` metres; false origins are given in these units."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84
    unit: float = 1.0

    def _radius(self) -> float:
        n = _third(self.ellipsoid)[0]
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n * n / 4 + n**4 / 64) / self.unit

    def _origin(self) -> float:
        """The northing of (lon0, lat0) on the sphere of the series."""
        n, e = _third(self.ellipsoid)
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(_series(n, TO_PLANE), 1))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, e = _third(self.ellipsoid)
        s, d = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        sphere = _pair(F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.hypot(t, F.cos(d))))
        plane = _let(sphere, lambda v: _pair(*self._moved(v["a"], v["b"], _series(n, TO_PLANE))))
        return plane["b"] * self._radius() + self.east, (plane["a"] - self._origin()) * self._radius() + self.north

    @staticmethod
    def _moved(xi: Column, eta: Column, c: list[float]) -> tuple[Column, Column]:
        return (
            sum((F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a for j, a in enumerate(c, 1)), xi),
            sum((F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a for j, a in enumerate(c, 1)), eta),
        )

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - self.north) / self._radius() + self._origin(), (x - self.east) / self._radius()
        back = [-b for b in _series(_third(self.ellipsoid)[0], FROM_PLANE)]
        sphere = _let(_pair(xi, eta), lambda v: _pair(*self._moved(v["a"], v["b"], back)))
        xi1, eta1 = sphere["a"], sphere["b"]
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + self.lon0, F.degrees(_geodetic(chi, self.ellipsoid))


@dataclass(frozen=True)
class LambertConic:
    """Degrees to easting and northing on a cone through two parallels, in units of `unit` metres."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east: float
    north: float
    ellipsoid: tuple[float, float] = GRS80
    unit: float = 1.0

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale, and the radius of lat0."""
        e = _third(self.ellipsoid)[1]

        def m(lat):
            s = math.sin(math.radians(lat))
            return math.cos(math.radians(lat)) / math.sqrt(1 - (e * s) ** 2)

        def t(lat):
            s = math.sin(math.radians(lat))
            return math.exp(e * math.atanh(e * s) - math.atanh(s))

        n = (math.log(m(self.lat1)) - math.log(m(self.lat2))) / (math.log(t(self.lat1)) - math.log(t(self.lat2))) if self.lat1 != self.lat2 else math.sin(math.radians(self.lat1))
        size = self.ellipsoid[0] / self.unit * m(self.lat1) / (n * t(self.lat1) ** n)
        return n, size, size * t(self.lat0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, (n, size, r0) = _third(self.ellipsoid)[1], self._cone()
        s = F.sin(F.radians(lat))
        r = F.exp((F.atanh(s * e) * e - F.atanh(s)) * n) * size
        turn = F.radians(lon - self.lon0) * n
        return r * F.sin(turn) + self.east, F.lit(r0 + self.north) - r * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, size, r0 = self._cone()
        side = math.copysign(1.0, n)
        dx, dy = (x - self.east) * side, (F.lit(r0 + self.north) - y) * side
        t = F.exp(F.log(F.hypot(dx, dy) / abs(size)) / n)
        chi = F.lit(math.pi / 2) - F.atan(t) * 2
        return F.degrees(F.atan2(dx, dy) / n) + self.lon0, F.degrees(_geodetic(chi, self.ellipsoid))


@dataclass(frozen=True)
class WebMercator:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return to_mercator(lon, lat)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return from_mercator(x, y)


@dataclass(frozen=True)
class Degrees:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


# Parallels, origin and false origin (in US survey feet) of the five zones of Texas.
_TEXAS = {
    2275: (36 + 11 / 60, 34.65, 34.0, -101.5, 656_166.6666666665, 3_280_833.333333333),
    2276: (33 + 58 / 60, 32 + 8 / 60, 31 + 40 / 60, -98.5, 1_968_500.0, 6_561_666.666666666),
    2277: (31 + 53 / 60, 30 + 7 / 60, 29 + 40 / 60, -100 - 20 / 60, 2_296_583.333333333, 9_842_500.0),
    2278: (30 + 17 / 60, 28 + 23 / 60, 27 + 50 / 60, -99.0, 1_968_500.0, 13_123_333.33333333),
    2279: (27 + 50 / 60, 26 + 10 / 60, 25 + 40 / 60, -98.5, 984_250.0, 16_404_166.66666666),
}


def projection(code: str | int):
    """The projection of an EPSG code: 4326, 4269, 3857, UTM zones (326zz, 327zz, 269zz), the state planes 2275 to 2279 in feet."""
    n = int(str(code).upper().removeprefix("EPSG:"))
    if n in (4326, 4269):
        return Degrees()
    if n == 3857:
        return WebMercator()
    if n in _TEXAS:
        return LambertConic(*_TEXAS[n], unit=US_FOOT)
    zone = n % 100
    if n // 100 in (326, 327, 269) and 1 <= zone <= 60:
        return TransverseMercator(zone * 6 - 183.0, north=10_000_000.0 if n // 100 == 327 else 0.0, ellipsoid=GRS80 if n // 100 == 269 else WGS84)
    raise ValueError(f"EPSG:{n} isn't known")


def reproject(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    return projection(target).forward(*projection(source).inverse(x, y))


def reproject_by(x: Column, y: Column, source: Column, codes: list[str], target: str | int) -> Column:
    """A struct (x, y) of points whose own source code is one of `codes`; null for any other."""
    out = F.lit(None)
    for c in codes:
        u, v = reproject(x, y, c, target)
        out = F.when(source == c, F.struct(u.alias("x"), v.alias("y"))).otherwise(out)
    return out


def reproject_affine(t: Column, source: str | int, target: str | int) -> Column:
    """An affine struct (pixels to `source`) with its origin in `target`, and for each of its four other numbers r the distance between the images of (0, r) and (0, 0), with the sign of r."""
    p, zero = lambda x, y: reproject(x, y, source, target), F.lit(0.0)
    c, f = p(t["c"], t["f"])
    ox, oy = p(zero, zero)

    def length(r: Column) -> Column:
        x, y = p(zero, r)
        return F.signum(r) * F.hypot(x - ox, y - oy)

    return affine(length(t["a"]), length(t["b"]), c, length(t["d"]), length(t["e"]), f)

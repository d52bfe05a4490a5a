"""Geometry and projection as Columns. A ring is an array of structs (x, y), closed or not; degrees are WGS84."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import cos, log, pi, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

DEG = pi / 180
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of Krueger's series in the third flattening, to the fourth order.
_FORWARD = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_BACK = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
_LAT = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)
_ECC = 2 * _N**0.5 / (1 + _N)


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def once(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once per row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df, columns: dict[str, Column]):
    """``df`` with new columns that are computed once per row, whatever stands above."""
    made = df.withColumn("made_", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*df.columns, *[F.col("made_")[n].alias(n) for n in columns])


def utm_zone(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def box_epsg(w: Column, s: Column, e: Column, n: Column) -> Column:
    return utm_epsg((w + e) / 2, (s + n) / 2)


def utm_xy(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone, by the Krueger series to the fourth order."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.pow(F.cos(lam), 2)))
    x = eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    y = xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    return 500000.0 + K0 * _RADIUS * x, K0 * _RADIUS * y + F.when(lat < 0, 10000000.0).otherwise(0.0)


def utm_lonlat(x: Column, y: Column, zone: Column, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM easting and northing."""
    eta0, xi0 = (x - 500000.0) / (K0 * _RADIUS), (y - (10000000.0 if south else 0.0)) / (K0 * _RADIUS)
    xi = xi0 - _sum(b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(_BACK, 1))
    eta = eta0 - _sum(b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(_BACK, 1))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + _sum(d * F.sin(2 * j * chi) for j, d in enumerate(_LAT, 1))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(lat)


#: Metres of a US survey foot.
SURVEY_FOOT = 1200 / 3937


@dataclass(frozen=True)
class Conic:
    """A Lambert conformal conic projection with two standard parallels, in degrees; false easting and northing in metres, ``unit`` metres a unit of its coordinates. The ellipsoid is GRS 80 unless given."""

    parallel1: float
    parallel2: float
    latitude0: float
    longitude0: float
    easting: float = 0.0
    northing: float = 0.0
    unit: float = 1.0
    axis: float = 6378137.0
    flattening: float = 1 / 298.257222101

    def _constants(self) -> tuple[float, float, float, float]:
        """Eccentricity, cone constant, scale and radius at the origin."""
        e = sqrt(self.flattening * (2 - self.flattening))
        m = lambda phi: cos(phi) / sqrt(1 - (e * sin(phi)) ** 2)
        t = lambda phi: tan(pi / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2)
        p1, p2, p0 = (x * DEG for x in (self.parallel1, self.parallel2, self.latitude0))
        n = sin(p1) if p1 == p2 else (log(m(p1)) - log(m(p2))) / (log(t(p1)) - log(t(p2)))
        scale = m(p1) / (n * t(p1) ** n)
        return e, n, scale, self.axis * scale * t(p0) ** n

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, scale, rho0 = self._constants()
        phi = F.radians(lat)
        es = e * F.sin(phi)
        t = F.tan(pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
        rho, theta = self.axis * scale * F.pow(t, F.lit(n)), n * F.radians(lon - self.longitude0)
        return (self.easting + rho * F.sin(theta)) / self.unit, (self.northing + rho0 - rho * F.cos(theta)) / self.unit

    def lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude; the latitude by its series in the eccentricity."""
        e, n, scale, rho0 = self._constants()
        dx, dy = x * self.unit - self.easting, rho0 - (y * self.unit - self.northing)
        sign = 1.0 if n > 0 else -1.0
        rho = sign * F.sqrt(dx * dx + dy * dy)
        chi = pi / 2 - 2 * F.atan(F.pow(rho / (self.axis * scale), F.lit(1 / n)))
        e2 = e * e
        terms = (
            e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
            7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280,
        )
        lat = chi + _sum(c * F.sin(2 * j * chi) for j, c in enumerate(terms, 1))
        return F.degrees(F.atan2(sign * dx, sign * dy) / n) + self.longitude0, F.degrees(lat)


#: The state plane of North Carolina in survey feet, in which the county's parcel layer comes.
NORTH_CAROLINA_FEET = Conic(34 + 20 / 60, 36 + 10 / 60, 33.75, -79.0, 609601.2192024384, 0.0, SURVEY_FOOT)


def to_degrees(shape: Column, conic: Conic) -> Column:
    """A shape in the coordinates of a conic projection, in degrees."""

    def point(p: Column) -> Column:
        lon, lat = conic.lonlat(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(shape, lambda ring: F.transform(ring, point))


def bbox_km2(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.abs(111.320 * F.cos(F.radians((s + n) / 2)) * (e - w) * 110.574 * (n - s))


def buffered(w: Column, s: Column, e: Column, n: Column, metres: float) -> tuple[Column, ...]:
    dlat = F.lit(metres) / 111320.0
    dlon = F.lit(metres) / F.greatest(F.lit(1.0), 111320.0 * F.cos(F.radians((s + n) / 2)))
    return w - dlon, s - dlat, e + dlon, n + dlat


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area; 0 for fewer than three points. Coordinates are taken from the first point, as small lots lie far from the origin."""
    n = F.size(ring)
    x = lambda p: p["x"] - F.get(ring, F.lit(0))["x"]
    y = lambda p: p["y"] - F.get(ring, F.lit(0))["y"]
    cross = F.transform(ring, lambda p, i: x(p) * y(F.get(ring, (i + 1) % n)) - x(F.get(ring, (i + 1) % n)) * y(p))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(ring, lambda p, i: F.coalesce(crosses(p, i), F.lit(False)))) % 2 == 1


def boxes_meet(a: tuple, b: tuple) -> Column:
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def rounded_ring(ring: Column, digits: int = 6) -> Column:
    return F.transform(ring, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))


def projected(ring: Column, zone: Column) -> Column:
    """A ring of degrees in metres of a UTM zone."""

    def point(p: Column) -> Column:
        x, y = utm_xy(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def ring_m2(ring: Column) -> Column:
    """Square metres of a ring of degrees, by the UTM zone of its centre."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    zone = utm_zone((F.array_min(xs) + F.array_max(xs)) / 2)
    return F.when(F.size(ring) < 3, 0.0).otherwise(once(projected(ring, zone), ring_area))


def clipped(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a ring inside a box, one side of the box after the other; exact for convex rings, and its area is for all."""

    def cut(points: Column, inside, cross) -> Column:
        n = F.size(points)

        def step(q: Column, i: Column) -> Column:
            p = F.get(points, (i + n - 1) % n)
            return F.filter(F.array(F.when(inside(p) != inside(q), cross(p, q)), F.when(inside(q), q)), lambda v: v.isNotNull())

        return F.flatten(F.transform(points, step))

    halved = lambda f, inside, cross: lambda points: f(points, inside, cross)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    at_x = lambda x: lambda p, q: point(x, p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0.0)))
    at_y = lambda y: lambda p, q: point(p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)), y)
    for inside, cross in ((lambda p: p["x"] >= x0, at_x(x0)), (lambda p: p["x"] <= x1, at_x(x1)), (lambda p: p["y"] >= y0, at_y(y0)), (lambda p: p["y"] <= y1, at_y(y1))):
        ring = once(ring, halved(cut, inside, cross))
    return ring


def grid(w: Column, s: Column, e: Column, n: Column, gsd: Column) -> dict[str, Column]:
    """The north-up pixel grid over a box of degrees in its UTM zone: epsg, left, bottom, right, top in metres on whole pixels, width and height in pixels."""
    zone = utm_zone((w + e) / 2)
    corners = [utm_xy(x, y, zone) for x, y in ((w, s), (w, n), (e, s), (e, n))]
    left, right = F.floor(F.least(*[c[0] for c in corners]) / gsd) * gsd, F.ceil(F.greatest(*[c[0] for c in corners]) / gsd) * gsd
    bottom, top = F.floor(F.least(*[c[1] for c in corners]) / gsd) * gsd, F.ceil(F.greatest(*[c[1] for c in corners]) / gsd) * gsd
    cells = lambda a, b: F.greatest(F.lit(1), F.rint((b - a) / gsd).cast("int"))
    return {"epsg": utm_epsg((w + e) / 2, (s + n) / 2), "left": left, "bottom": bottom, "right": right, "top": top, "width": cells(left, right), "height": cells(bottom, top)}


def grid_degrees(left: Column, bottom: Column, right: Column, top: Column, zone: Column) -> tuple[Column, ...]:
    """west, south, east, north of a grid's bounds."""
    corners = [utm_lonlat(x, y, zone) for x, y in ((left, bottom), (left, top), (right, bottom), (right, top))]
    return F.least(*[c[0] for c in corners]), F.least(*[c[1] for c in corners]), F.greatest(*[c[0] for c in corners]), F.greatest(*[c[1] for c in corners])


def parse_bbox(given: str | list[float] | tuple[float, ...]) -> tuple[float, float, float, float]:
    """west, south, east, north from text or numbers; reversed ends are swapped."""
    parts = [float(x) for x in (given.split(",") if isinstance(given, str) else given)]
    if len(parts) != 4:
        raise ValueError("a box has four numbers: west, south, east, north")
    w, s, e, n = parts
    w, e, s, n = min(w, e), max(w, e), min(s, n), max(s, n)
    if not (-180 <= w and e <= 180 and -90 <= s and n <= 90):
        raise ValueError("a box lies within 180 degrees of longitude and 90 of latitude")
    return w, s, e, n

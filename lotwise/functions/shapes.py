"""Polygons of any form as Columns. A shape is an array of rings, a ring an array of structs (x, y), closed or not.

A point belongs to a shape if a line from it crosses the rings an odd number of times, so holes and several parts need no marks: they are rings like all others.
Areas are summed over slabs: between two neighbouring heights of vertices and crossings all edges are straight and do not meet, so a slab's area is its height times the length inside at half of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.geo import once

#: What two shapes share must exceed this part of the smaller one's area to count: less is the rounding of edges that only touch.
LEAST_SHARE = 1e-9


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def edges(shape: Column, origin: Column | None = None) -> Column:
    """(x0, y0, x1, y1) of all edges, from an origin (x, y) if one is given; closing points make edges of no length."""
    ox, oy = (F.lit(0.0), F.lit(0.0)) if origin is None else (origin["x"], origin["y"])

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def edge(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            return F.struct((p["x"] - ox).alias("x0"), (p["y"] - oy).alias("y0"), (q["x"] - ox).alias("x1"), (q["y"] - oy).alias("y1"))

        return F.transform(ring, edge)

    return F.flatten(F.transform(shape, of_ring))


def _rising(sides: Column) -> Column:
    """The edges that are not level, from their lower to their upper end."""
    turned = lambda e: F.when(e["y0"] < e["y1"], e).otherwise(F.struct(e["x1"].alias("x0"), e["y1"].alias("y0"), e["x0"].alias("x1"), e["y0"].alias("y1")))
    return F.transform(F.filter(sides, lambda e: e["y0"] != e["y1"]), turned)


def _x_at(e: Column, y: Column) -> Column:
    return e["x0"] + (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"])


def _crossing_heights(some: Column) -> Column:
    """Heights at which two of the rising edges cross inside both."""

    def height(p: Column, q: Column) -> Column:
        s, t = (p["x1"] - p["x0"]) / (p["y1"] - p["y0"]), (q["x1"] - q["x0"]) / (q["y1"] - q["y0"])
        y = (q["x0"] - t * q["y0"] - p["x0"] + s * p["y0"]) / F.nullif(s - t, F.lit(0.0))
        return F.when((y > F.greatest(p["y0"], q["y0"])) & (y < F.least(p["y1"], q["y1"])), y)

    return F.flatten(F.transform(some, lambda p, i: F.filter(F.transform(F.slice(some, i + 2, F.size(some)), lambda q: height(p, q)), lambda y: y.isNotNull())))


def _slabs(some: Column) -> Column:
    """(lo, hi) of the slabs between the heights of rising edges' ends and crossings."""
    ends = F.concat(F.transform(some, lambda e: e["y0"]), F.transform(some, lambda e: e["y1"]), _crossing_heights(some))
    pairs = lambda ys: F.transform(F.slice(ys, 2, F.greatest(F.size(ys), F.lit(1))), lambda y, i: F.struct(F.get(ys, i).alias("lo"), y.alias("hi")))
    return once(F.array_sort(F.array_distinct(ends)), pairs)


def shared_area(a: Column, b: Column) -> Column:
    """The area that two shapes share; 0 if one is null or has no area."""
    origin = F.get(F.get(a, F.lit(0)), F.lit(0))

    def summed(two: Column) -> Column:
        def slab(s: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            over = lambda e, k: F.transform(F.filter(e, lambda x: (x["y0"] < mid) & (mid < x["y1"])), lambda x: F.struct(_x_at(x, mid).alias("x"), F.lit(k).alias("k")))
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("x"), F.lit(0).alias("k"))
            step = lambda t, e: F.struct((t["sum"] + F.when(t["k"] == 3, e["x"] - t["x"]).otherwise(0.0)).alias("sum"), e["x"].alias("x"), t["k"].bitwiseXOR(e["k"]).alias("k"))
            return (s["hi"] - s["lo"]) * F.aggregate(F.array_sort(F.concat(over(two["a"], 1), over(two["b"], 2))), start, step, lambda t: t["sum"])

        return _total(F.transform(_slabs(F.concat(two["a"], two["b"])), slab))

    rising = F.struct(_rising(edges(a, origin)).alias("a"), _rising(edges(b, origin)).alias("b"))
    return F.coalesce(once(rising, summed), F.lit(0.0))


def area(shape: Column) -> Column:
    """The area of a shape, also of one whose rings cross themselves or each other."""
    origin = F.get(F.get(shape, F.lit(0)), F.lit(0))

    def summed(some: Column) -> Column:
        inside = lambda y: F.transform(spans(some, y), lambda s: s["hi"] - s["lo"])
        return _total(F.transform(_slabs(some), lambda s: (s["hi"] - s["lo"]) * _total(inside((s["lo"] + s["hi"]) / 2))))

    return F.coalesce(once(_rising(edges(shape, origin)), summed), F.lit(0.0))


def inside(x: Column, y: Column, shape: Column) -> Column:
    """True if a point lies in a shape."""
    crossed = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"])
    return F.size(F.filter(edges(shape), lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def _segments_meet(p: Column, q: Column) -> Column:
    """True if two closed line segments have a point in common."""

    def side(a: Column, x: Column, y: Column) -> Column:
        return F.signum((a["x1"] - a["x0"]) * (y - a["y0"]) - (a["y1"] - a["y0"]) * (x - a["x0"]))

    near = (F.greatest(p["x0"], p["x1"]) >= F.least(q["x0"], q["x1"])) & (F.greatest(q["x0"], q["x1"]) >= F.least(p["x0"], p["x1"]))
    near = near & (F.greatest(p["y0"], p["y1"]) >= F.least(q["y0"], q["y1"])) & (F.greatest(q["y0"], q["y1"]) >= F.least(p["y0"], p["y1"]))
    return near & (side(p, q["x0"], q["y0"]) * side(p, q["x1"], q["y1"]) <= 0) & (side(q, p["x0"], p["y0"]) * side(q, p["x1"], p["y1"]) <= 0)


def meet(a: Column, b: Column) -> Column:
    """True if two shapes have a point in common, be it of their borders only; false for null."""
    touch = lambda two: F.exists(two["a"], lambda p: F.exists(two["b"], lambda q: _segments_meet(p, q)))
    within = lambda s, t: F.exists(s, lambda ring: inside(F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"], t))
    return F.coalesce(once(F.struct(edges(a).alias("a"), edges(b).alias("b")), touch) | within(a, b) | within(b, a), F.lit(False))


def distance2(x: Column, y: Column, sides: Column) -> Column:
    """Square of the distance from a point to the nearest of some edges."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        along = F.coalesce(((x - e["x0"]) * dx + (y - e["y0"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.pow(x - e["x0"] - t * dx, F.lit(2)) + F.pow(y - e["y0"] - t * dy, F.lit(2))

    return F.array_min(F.transform(sides, to_edge))


def spans(sides: Column, y: Column) -> Column:
    """(lo, hi) of the intervals of a level line inside the shape with these edges."""
    xs = F.array_sort(F.transform(F.filter(sides, lambda e: (e["y0"] > y) != (e["y1"] > y)), lambda e: _x_at(e, y)))
    return once(xs, lambda v: F.filter(F.transform(v, lambda x, i: F.when(i % 2 == 1, F.struct(F.get(v, i - 1).alias("lo"), x.alias("hi")))), lambda s: s.isNotNull()))


def interior_point(shape: Column) -> Column:
    """A point (x, y) that surely lies inside: the middle of the widest interval on a level line halfway between two neighbouring vertex heights, those next to the middle of the shape if there is any interval."""

    def found(sides: Column) -> Column:
        def at(lo: Column, hi: Column, middle: Column) -> Column:
            y = (lo + hi) / 2
            start = F.struct(F.lit(-1.0).alias("w"), F.lit(None).cast("double").alias("x"))
            wider = lambda a, s: F.when(s["hi"] - s["lo"] > a["w"], F.struct((s["hi"] - s["lo"]).alias("w"), ((s["lo"] + s["hi"]) / 2).alias("x"))).otherwise(a)
            away = F.when((lo <= middle) & (middle < hi), F.lit(0.0)).otherwise(F.least(F.abs(lo - middle), F.abs(hi - middle)))
            return F.struct(away.alias("away"), F.aggregate(spans(sides, y), start, wider, lambda a: a["x"]).alias("x"), y.alias("y"))

        def levels(ys: Column) -> Column:
            middle = (F.element_at(ys, 1) + F.element_at(ys, -1)) / 2
            every = F.transform(F.slice(ys, 2, F.greatest(F.size(ys), F.lit(1))), lambda hi, i: at(F.get(ys, i), hi, middle))
            return once(F.array_min(F.filter(every, lambda p: p["x"].isNotNull())), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

        return once(F.array_sort(F.array_distinct(F.transform(sides, lambda e: e["y0"]))), levels)

    return once(edges(shape), found)


def box(x0, y0, x1, y1) -> Column:
    """A box as a shape."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def given(rings: list[list[tuple[float, float]]]) -> Column:
    """A shape of given numbers."""
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in rings])

"""Zones over pixels: labelling, grouped statistics, nearest-rank quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import geo, shapes
from lotwise.sources.tables import stored

#: Parts of a large zone's range that its pixels are counted in.
PARTS = 1024
#: Pixels of a zone that are sorted as one array.
MOST_AT_ONCE = 1 << 16
#: Rows of a band of a shape, and edges of pixel rows that are worked on at once.
BAND, MOST_SIDES = 64, 200_000


def line_runs(zones: DataFrame, all_touched: bool = False, inset: Column | float | None = None) -> DataFrame:
    """The columns of ``zones`` without its shapes, and each pixel row of each shape that has pixels: row, cols (runs of columns, a to b), and ``deep``, the runs of those whose centre keeps the distance ``inset``
    from all edges (with an inset only; a null one counts as 0).

    ``zones`` has a ``shape`` (rings in pixel coordinates, by the even-odd rule over all of them) or a ``ring``; pixels count whose centre lies in it, or that it touches at all. A shape is cut to bands of rows, and
    the edges near a band, in Arrow batches, give the runs of its rows, so no row of data holds more than the edges of a band or the runs of one line.
    """
    whole = lambda c: F.floor(c).cast("long")
    shape = F.col("shape") if "shape" in zones.columns else F.array("ring")
    own = [c for c in zones.columns if c not in ("shape", "ring")]
    keeps = F.lit(0.0) if inset is None else F.coalesce(inset if isinstance(inset, Column) else F.lit(float(inset)), F.lit(0.0))
    every = zones.select(*own, shapes.edges(shape).alias("sides"), keeps.alias("keeps")).where(F.size("sides") > 0)
    ends = F.concat(F.transform("sides", lambda e: e["y0"]), F.transform("sides", lambda e: e["y1"]))
    reach = F.struct(F.array_min(ends).alias("lo"), F.array_max(ends).alias("hi"))
    bands = every.withColumn("reach", reach).select("*", F.explode(F.sequence(whole(F.col("reach.lo") / BAND), whole(F.col("reach.hi") / BAND))).alias("band"))
    low, high = F.col("band") * BAND, (F.col("band") + 1) * BAND
    meets = F.filter("sides", lambda e: (F.greatest(e["y0"], e["y1"]) >= low - F.col("keeps")) & (F.least(e["y0"], e["y1"]) <= high + F.col("keeps")))
    ready = bands.select(*own, "keeps", meets.alias("near"), F.greatest(whole(F.col("reach.lo")), low).alias("top"), F.least(whole(F.col("reach.hi")), high - 1).alias("bottom"))
    made = ["cols"] if inset is None else ["cols", "deep"]
    out = T.StructType([ready.schema[c] for c in own]).add("row", "long")
    for c in made:
        out = out.add(c, T.ArrayType(T.StructType().add("a", "long").add("b", "long")))
    return ready.mapInArrow(lambda batches: _lines(batches, own, made, all_touched), out)


def pixels_of(runs: Column | str) -> Column:
    """The columns of runs, as an array."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"])))


def shape_lines(zones: DataFrame, all_touched: bool = False, inset: Column | float | None = None) -> DataFrame:
    """``line_runs`` with the columns one by one: cols, and with an inset deep, as arrays."""
    lines = line_runs(zones, all_touched, inset)
    return lines.withColumns({c: pixels_of(c) for c in lines.columns if c == "cols" or c == "deep" and inset is not None})


def _lines(batches: Iterator[pa.RecordBatch], own: list[str], made: list[str], all_touched: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = batch.column("near")
        held = pc.list_value_length(sides).fill_null(0).to_numpy().astype(np.int64)
        edges = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in sides.flatten().flatten()]  # x0, y0, x1, y1
        top, bottom, keeps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("top", "bottom", "keeps"))
        high = np.maximum(bottom - top + 1, 0)
        band = np.repeat(np.arange(len(high)), high)
        row = top[band] + np.arange(len(band)) - np.repeat(np.cumsum(high) - high, high)
        begin = np.cumsum(held) - held
        part = np.cumsum(held[band] + 1) // MOST_SIDES
        for k in np.split(np.arange(len(band)), np.flatnonzero(np.diff(part)) + 1):
            if len(k):
                runs = _runs(edges, begin[band[k]], held[band[k]], row[k], keeps[band[k]], all_touched)
                some = np.flatnonzero(np.bincount(runs["cols"][0], minlength=len(k)))
                lists = []
                for c in made:
                    line, a, b = runs[c]
                    ends = np.append(0, np.cumsum(np.bincount(line, minlength=len(k))[some]))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])))
                at = pa.array(band[k][some])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in own], pa.array(row[k][some], pa.int64()), *lists], [*own, "row", *made])


def _runs(edges: list[np.ndarray], begin: np.ndarray, held: np.ndarray, row: np.ndarray, keeps: np.ndarray, all_touched: bool) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, a, b) of the runs of some pixel rows, in order: cols and deep. Line i has ``held[i]`` edges from ``begin[i]`` on."""
    line = np.repeat(np.arange(len(row)), held)
    at = np.arange(len(line)) + np.repeat(begin - (np.cumsum(held) - held), held)
    x0, y0, x1, y1 = (e[at] for e in edges)
    y, r = row[line] + 0.5, keeps[line]
    whole = lambda v: v.astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        # pixels whose centre lies in [lo, hi) of an interval between two crossings
        xs = x0 + (x1 - x0) * (y - y0) / (y1 - y0)
        cross = ((y0 > y) != (y1 > y)) & ~np.isnan(xs)
        on, xs = line[cross], xs[cross]
        order = np.lexsort((xs, on))
        on, xs = on[order], xs[order]
        count = np.bincount(on, minlength=len(row))
        odd = np.flatnonzero((np.arange(len(on)) - np.repeat(np.cumsum(count) - count, count)) % 2 == 1)
        found = [(on[odd], whole(np.ceil(xs[odd - 1] - 0.5)), whole(np.ceil(xs[odd] - 0.5)) - 1)]
        if all_touched:
            found.append((line, *_touched(x0, y0, x1, y1, row[line])))
        lo, hi = _close(x0, y0, x1, y1, r, y)
        near = (r > 0) & ~np.isnan(lo)
        shut = line[near], whole(np.floor(lo[near] - 0.5)) + 1, whole(np.ceil(hi[near] - 0.5)) - 1
    # where runs begin and end, in order; what is open behind each of these places
    events = [(n, a, b, kind) for kind, (n, a, b) in ((0, x) for x in found)] + [(*shut, 1)]
    n, place, step, kind = [], [], [], []
    for on, a, b, which in events:
        good = a <= b
        n += [on[good], on[good]]
        place += [a[good], b[good] + 1]
        step += [np.ones(good.sum(), np.int64), -np.ones(good.sum(), np.int64)]
        kind += [np.full(2 * good.sum(), which)]
    n, place, step, kind = (np.concatenate(v) for v in (n, place, step, kind))
    order = np.lexsort((place, n))
    n, place, step, kind = n[order], place[order], step[order], kind[order]
    inside, closed = np.cumsum(np.where(kind == 0, step, 0)), np.cumsum(np.where(kind == 1, step, 0))
    until = np.append(place[1:], 0)
    real = np.append(n[1:] == n[:-1], False) & (until > place) & (inside > 0)

    def joined(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on, a, b = n[chosen], place[chosen], until[chosen] - 1
        apart = (on[1:] != on[:-1]) | (a[1:] != b[:-1] + 1)
        first, last = np.append(True, apart)[: len(on)], np.append(apart, True)[: len(on)]
        return on[first], a[first], b[last]

    return {"cols": joined(real), "deep": joined(real & (closed == 0))}


def _close(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of the part of a level line that is nearer than ``r`` to an edge, nan where none is: a line meets what surrounds an edge, which is convex, in one interval."""
    dx, dy = x1 - x0, y1 - y0
    length = np.sqrt(dx * dx + dy * dy)

    def round_end(x: np.ndarray, at: np.ndarray, sign: int) -> np.ndarray:
        left = r * r - (y - at) ** 2
        return np.where(left > 0, x + sign * np.sqrt(left), np.nan)

    def beside(sign: int) -> np.ndarray:
        ox, oy = sign * r * dy / length, -sign * r * dx / length
        a, b = y0 + oy, y1 + oy
        return np.where((np.minimum(a, b) <= y) & (y <= np.maximum(a, b)) & (dy != 0), x0 + ox + dx * (y - a) / dy, np.nan)

    both = beside(1), beside(-1)
    least, most = (np.fmin.reduce, -1), (np.fmax.reduce, 1)
    return tuple(pick([round_end(x0, y0, sign), round_end(x1, y1, sign), *both]) for pick, sign in (least, most))


def _touched(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last pixel of a row whose open square an edge passes through; the last before the first where it passes through none."""
    lo, hi = np.maximum(np.minimum(y0, y1), row), np.minimum(np.maximum(y0, y1), row + 1.0)
    level = y0 == y1
    x_at = lambda y: x0 + (x1 - x0) * (y - y0) / (y1 - y0)
    at_lo, at_hi = x_at(lo), x_at(hi)
    a, b = np.where(level, np.minimum(x0, x1), np.minimum(at_lo, at_hi)), np.where(level, np.maximum(x0, x1), np.maximum(at_lo, at_hi))
    passes = ((lo < hi) | level & (y0 > row) & (y0 < row + 1)) & ~((a == b) & (a == np.floor(a)))
    last = np.where(a == b, np.floor(a), np.ceil(b) - 1)
    return np.where(passes, np.floor(a), 1).astype(np.int64), np.where(passes, last, 0).astype(np.int64)


def label_rings(zones: DataFrame, all_touched: bool = False) -> DataFrame:
    """(row, col, zone) from shapes in pixel coordinates (see line_runs); of several zones on a pixel the one with the largest ``ord`` stays.

    ``zones`` has (zone, ord, ring or shape), (cx, cy, radius) where a zone is cut to a disc, and inset where it keeps a distance from its edges.
    """
    if "inset" in zones.columns:
        cells = line_runs(zones, all_touched, F.col("inset")).withColumn("col", F.explode(pixels_of("deep")))
    else:
        cells = line_runs(zones, all_touched).withColumn("col", F.explode(pixels_of("cols")))
    if "radius" in zones.columns:
        away = lambda c, x: F.greatest(x - F.col(c), F.col(c) - x - 1, F.lit(0.0)) if all_touched else F.col(c) - x - 0.5
        cells = cells.where(F.col("radius").isNull() | (F.pow(away("cx", F.col("col")), F.lit(2)) + F.pow(away("cy", F.col("row")), F.lit(2)) < F.pow("radius", F.lit(2))))
    return cells.groupBy("row", "col").agg(F.max_by("zone", "ord").alias("zone"))


def stats(pixels: DataFrame, layers: dict[str, str], zone: str = "zone", valid: str = "valid") -> DataFrame:
    """Per zone: pixels and, for each name and layer, the mean (of a boolean, the share)."""
    used = pixels.where((F.col(zone) > 0) & F.col(valid))
    kinds = dict(pixels.dtypes)
    mean = lambda c: F.avg(F.col(c).cast("double") if kinds[c] == "boolean" else F.col(c))
    return used.groupBy(zone).agg(F.count("*").alias("pixels"), *[mean(c).alias(n) for n, c in layers.items()])


def totals(pixels: DataFrame, layers: dict[str, str], zone: str = "zone", valid: str = "valid") -> DataFrame:
    """Per zone: pixels and, for each name and layer, the sum."""
    used = pixels.where((F.col(zone) > 0) & F.col(valid))
    return used.groupBy(zone).agg(F.count("*").alias("pixels"), *[F.sum(F.col(c).cast("double")).alias(n) for n, c in layers.items()])


def nearest_rank(pixels: DataFrame, value: str, q: float, name: str, zone: str = "zone", valid: str = "valid", most: int = MOST_AT_ONCE) -> DataFrame:
    """Per zone the value of rank rint(q * (n - 1)), without interpolation.

    Zones are counted first. Those of up to ``most`` pixels are sorted as an array each. The range of a larger one is counted in equal parts, and the part with the wanted rank again, until it holds
    no more than that or one value only; so no task ever sorts a large zone.
    """
    used = pixels.where((F.col(zone) > 0) & F.col(valid)).select(F.col(zone).alias("z"), F.col(value).cast("double").alias("v"))
    pick = lambda values, rank: F.get(F.sort_array(F.collect_list(values)), rank)
    wanted = lambda n: F.rint(F.lit(q) * (n - 1)).cast("int")
    large = stored(used.groupBy("z").agg(F.count("*").alias("n")).where(F.col("n") > most))
    some = large.limit(1).count() > 0
    small = used.join(large.select("z"), "z", "left_anti") if some else used
    out = small.groupBy("z").agg(pick("v", wanted(F.count("*"))).alias("v"))
    if some:
        open_ = stored(used.join(large, "z").groupBy("z").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("k"), F.lit(0).cast("bigint").alias("below"), F.rint(F.lit(q) * (F.count("*") - 1)).cast("bigint").alias("rank")))
        unsettled = (F.col("k") > most) & (F.col("lo") < F.col("hi"))
        while open_.where(unsettled).limit(1).count():
            met = used.join(open_, "z").where(F.col("v").between(F.col("lo"), F.col("hi")))
            part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
            counts = met.groupBy("z", part.cast("int").alias("part")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("k"), F.first("below").alias("start"), F.first("rank").alias("rank"))
            before = F.coalesce(F.sum("k").over(Window.partitionBy("z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most PARTS rows of a zone
            placed = counts.withColumn("below", F.col("start") + before)
            open_ = stored(placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("k"))).select("z", "lo", "hi", "k", "below", "rank"))
        last = used.join(open_.where("lo < hi"), "z").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("z").agg(pick("v", F.first(F.col("rank") - F.col("below")).cast("int")).alias("v"))
        out = out.unionByName(last).unionByName(open_.where("lo = hi").select("z", F.col("lo").alias("v")))
    return out.select(F.col("z").alias(zone), F.col("v").alias(name))


def for_all(zones: DataFrame, found: DataFrame, zone: str = "zone") -> DataFrame:
    """Statistics with a row for zones without a usable pixel, too: 0 pixels, null figures."""
    return zones.select(zone).join(found, zone, "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))

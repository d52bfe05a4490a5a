"""Rings made simpler and rings made right: removal of points within a tolerance, and repair of rings that cross or touch themselves.

Both work on a column of shapes (arrays of rings) in Arrow batches, a shape at a time; a shape is as large as one row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A meeting nearer to an edge's end than this part of it is one at the end.
EDGE = 1e-9
Ring = np.ndarray  # of points, (n, 2), without a closing one


def _opened(ring: Ring) -> Ring:
    """Without repeated points and the closing one."""
    if len(ring) < 2:
        return ring
    kept = ring[np.append(True, (ring[1:] != ring[:-1]).any(1))]
    return kept[:-1] if len(kept) > 1 and (kept[0] == kept[-1]).all() else kept


def crossings(a: Ring, b: Ring) -> np.ndarray:
    """(i, j) of the edges of two rings that have an inner point of either in common, neighbours' common ends not counted."""
    p, r = a, np.roll(a, -1, 0) - a
    q, s = b, np.roll(b, -1, 0) - b
    across = r[:, None, 0] * s[None, :, 1] - r[:, None, 1] * s[None, :, 0]
    gap = q[None, :, :] - p[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * s[None, :, 1] - gap[..., 1] * s[None, :, 0]) / across
        u = (gap[..., 0] * r[:, None, 1] - gap[..., 1] * r[:, None, 0]) / across
    steep = np.abs(across) > EDGE * np.hypot(*r.T)[:, None] * np.hypot(*s.T)[None, :]  # edges of one line meet nowhere inside
    inner = steep & (t > EDGE) & (t < 1 - EDGE) & (u > EDGE) & (u < 1 - EDGE)
    return np.argwhere(inner)


# -- simplification ----------------------------------------------------------------------------------------------------


def _kept(points: Ring, tolerance: float) -> np.ndarray:
    """Mask of the points of a line that stay: the farthest from the chord between two that stay, as long as it is farther than the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        chord, away = points[hi] - points[lo], points[lo + 1 : hi] - points[lo]
        along = np.clip(away @ chord / max(chord @ chord, 1e-300), 0, 1)
        far = np.hypot(*(away - along[:, None] * chord).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[lo + 1 + k] = True
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return keep


def simplify(rings: list[Ring], tolerance: float) -> list[Ring]:
    """The shape with fewer points, none that was dropped farther than the tolerance from what is left. Where rings would cross or collapse the tolerance is halved, until the shape is as it was."""
    rings = [_opened(r) for r in rings]
    for _ in range(12):
        out = []
        for ring in rings:
            if len(ring) < 5:
                out.append(ring)
                continue
            # a ring is two lines, between its first point and the one farthest from it
            far = int(np.hypot(*(ring - ring[0]).T).argmax())
            if far == 0:
                out.append(ring)
                continue
            closed = np.vstack([ring, ring[:1]])
            keep = np.append(_kept(closed[: far + 1], tolerance)[:-1], _kept(closed[far:], tolerance))[:-1]
            out.append(ring[keep])
        if all(len(r) > 2 for r in out) and not any(len(crossings(a, b)) for i, a in enumerate(out) for b in out[i:]):
            return out
        tolerance /= 2
    return rings


# -- repair ------------------------------------------------------------------------------------------------------------


def _pieces(rings: list[Ring]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """The edges of the rings cut where they meet; pieces that lie on each other an even number of times are gone."""
    edges = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]
    at: list[dict[float, tuple[float, float]]] = [{0.0: tuple(a), 1.0: tuple(b)} for a, b in edges]
    for i, (a, b) in enumerate(edges):
        for j in range(i + 1, len(edges)):
            c, d = edges[j]
            if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
                continue
            r, s = b - a, d - c
            across = r[0] * s[1] - r[1] * s[0]
            if across:
                t, u = ((c - a)[0] * s[1] - (c - a)[1] * s[0]) / across, ((c - a)[0] * r[1] - (c - a)[1] * r[0]) / across
                if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                    ends = [tuple(x) for x, near in ((a, t), (b, 1 - t), (c, u), (d, 1 - u)) if abs(near) < 1e-12]
                    point = ends[0] if ends else tuple(a + t * r)
                    for k, x in ((i, t), (j, u)):
                        if 1e-12 < x < 1 - 1e-12:
                            at[k][x] = point
            elif abs((c - a)[0] * r[1] - (c - a)[1] * r[0]) <= 1e-12 * (r @ r):
                for k, (p, v), others in ((i, (a, r), (c, d)), (j, (c, s), (a, b))):
                    for o in others:
                        x = (o - p) @ v / (v @ v)
                        if 1e-12 < x < 1 - 1e-12:
                            at[k][x] = tuple(o)
    count: dict = defaultdict(int)
    for points in at:
        line = [points[x] for x in sorted(points)]
        for p, q in zip(line, line[1:]):
            if p != q:
                count[min(p, q), max(p, q)] += 1
    return [k for k, n in count.items() if n % 2]


def repair(rings: list[Ring]) -> list[Ring]:
    """The same even-odd area as rings that neither cross themselves nor each other: edges are cut where they meet, turned so that the inside lies on their left, and walked round by the leftmost way on."""
    rings = [r for r in map(_opened, rings) if len(r) > 2]
    if not rings or not any(len(crossings(a, b)) for i, a in enumerate(rings) for b in rings[i:]) and not _touching(rings):
        return rings
    pieces = _pieces(rings)
    if not pieces:
        return []
    ax, ay, bx, by = (np.array(v) for v in zip(*[(*p, *q) for p, q in pieces]))
    onward: dict = defaultdict(list)
    for p, q in pieces:
        mx, my = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
        own = (ax == p[0]) & (ay == p[1]) & (bx == q[0]) & (by == q[1])
        # a ray from its middle, upwards or to the right, crosses other pieces an odd number of times if that side is inside
        if p[1] == q[1]:
            y = ay + (by - ay) * (mx - ax) / np.where(bx == ax, 1, bx - ax)
            n = int((((ax > mx) != (bx > mx)) & (y > my) & ~own).sum())
            forward = (n % 2 == 1) == (q[0] > p[0])
        else:
            x = ax + (bx - ax) * (my - ay) / np.where(by == ay, 1, by - ay)
            n = int((((ay > my) != (by > my)) & (x > mx) & ~own).sum())
            forward = (n % 2 == 1) == (q[1] < p[1])
        a, b = (p, q) if forward else (q, p)
        onward[a].append(b)
    out = []
    while onward:
        start = next(iter(onward))
        ring, here, before = [start], onward[start].pop(), start
        if not onward[start]:
            del onward[start]
        while here != start and here in onward:
            ring.append(here)
            back = math.atan2(before[1] - here[1], before[0] - here[0])
            ways = onward[here]
            # the first way clockwise from the way back: the inside stays on the left and rings do not run through each other
            k = min(range(len(ways)), key=lambda i: (back - math.atan2(ways[i][1] - here[1], ways[i][0] - here[0])) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
            before, here = here, ways.pop(k)
            if not onward[before]:
                del onward[before]
        if len(ring) > 2:
            out.append(np.array(ring))
    return out


def _touching(rings: list[Ring]) -> bool:
    """True if a point stands twice or lies on another edge."""
    points = np.vstack(rings)
    if len(np.unique(points, axis=0)) < len(points):
        return True
    for ring in rings:
        for a, b in zip(ring, np.roll(ring, -1, 0)):
            d = b - a
            t = (points - a) @ d / max(d @ d, 1e-300)
            if (np.abs((points - a)[:, 0] * d[1] - (points - a)[:, 1] * d[0]) <= 1e-12 * (d @ d))[(t > 1e-12) & (t < 1 - 1e-12)].any():
                return True
    return False


# -- columns -----------------------------------------------------------------------------------------------------------


def _shapes(column: pa.Array) -> Iterator[list[Ring] | None]:
    """The shapes of a column as lists of point arrays; null for null, points that are not numbers left out."""
    outer = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for shape in outer:
        if not shape.is_valid:
            yield None
            continue
        rings = []
        for ring in shape.values:
            if ring.is_valid and ring.values is not None and len(ring.values):
                points = ring.values
                xy = np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], 1)
                rings.append(xy[np.isfinite(xy).all(1)])
        yield rings


def _with(df: DataFrame, column: str, work: Callable[[list[Ring]], list[Ring]]) -> DataFrame:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if s is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in work(s)] for s in _shapes(batch.column(column))]
            at = batch.schema.names.index(column)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(made, kind), *batch.columns[at + 1 :]], batch.schema.names)

    return df.mapInArrow(part, df.schema)


def simplified(df: DataFrame, column: str = "shape", tolerance: float = 1e-5) -> DataFrame:
    """``df`` with its shapes simplified (see ``simplify``)."""
    return _with(df, column, lambda rings: simplify(rings, tolerance))


def repaired(df: DataFrame, column: str = "shape") -> DataFrame:
    """``df`` with its shapes repaired (see ``repair``); one without an area is empty."""
    return _with(df, column, repair)

"""Neighbourhood operators over pixel tables: box means with replicated edges, structural similarity, windowed means.

An image is dealt out in square blocks. Each block comes with the pixels around it that its windows reach, by one shuffle, and its windows are sums of
arrays inside the task. An image is a full rectangle; beyond its edge the edge repeats, and a pixel that is missing inside counts as 0. ``keys`` names what tells images apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a block in pixels.
BLOCK = 256


def _box(values: np.ndarray, size: int, axis_low: tuple[int, int], axis_high: tuple[int, int], radius: int) -> np.ndarray:
    """Means over ``size`` x ``size`` of the inner part of an array that has ``radius`` pixels around it; rows and columns beyond the image repeat its edge."""
    clamp = lambda n, lo, hi: np.clip(np.arange(n), lo, hi)
    whole = values[np.ix_(clamp(values.shape[0], axis_low[0], axis_high[0]), clamp(values.shape[1], axis_low[1], axis_high[1]))]
    r = size // 2
    whole = whole[radius - r : whole.shape[0] - radius + r, radius - r : whole.shape[1] - radius + r]
    for axis in (0, 1):  # short sums of shifted views keep more digits than differences of running totals
        n = whole.shape[axis] - size + 1
        whole = sum(whole[:, k : k + n] if axis else whole[k : k + n] for k in range(size))
    return whole / size**2


def over_blocks(df: DataFrame, inputs: list[str], radius: int, made: dict[str, str], work: Callable, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with new columns ``made`` (name to type). ``work(arrays, mean)`` gets the input columns as arrays with ``radius`` pixels around the block, and a function
    ``mean(array, size)`` for the box means of the block, and returns the new columns as arrays of the block."""
    row, col = F.col("row"), F.col("col")
    edges = df.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    bounded = df.join(F.broadcast(edges), list(keys)) if keys else df.crossJoin(F.broadcast(edges))  # one row for each image
    near = lambda x, lo, hi: F.sequence(F.floor(F.greatest(x - radius, lo) / BLOCK), F.floor(F.least(x + radius, hi) / BLOCK))
    dealt = bounded.withColumn("_br", F.explode(near(row, F.col("_r0"), F.col("_r1")))).withColumn("_bc", F.explode(near(col, F.col("_c0"), F.col("_c1"))))
    shape = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *made.items()])
    inner = df.columns

    def one(table: pa.Table) -> pa.Table:
        rows, cols = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        first = lambda c: int(table[c][0].as_py())
        top, left = first("_br") * BLOCK - radius, first("_bc") * BLOCK - radius
        side = BLOCK + 2 * radius
        arrays = []
        for c in inputs:
            held = np.zeros((side, side))
            values = table[c].combine_chunks()
            held[rows - top, cols - left] = np.nan_to_num(values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
            arrays.append(held)
        low, high = (first("_r0") - top, first("_c0") - left), (first("_r1") - top, first("_c1") - left)
        limit = lambda x: min(max(x, 0), side - 1)
        low, high = tuple(map(limit, low)), tuple(map(limit, high))
        results = work(arrays, lambda values, size: _box(values, size, low, high, radius))
        own = (rows - top >= radius) & (rows - top < radius + BLOCK) & (cols - left >= radius) & (cols - left < radius + BLOCK)
        out = table.select(inner).filter(pa.array(own))
        at = rows[own] - top - radius, cols[own] - left - radius
        for name, values in zip(made, results):
            out = out.append_column(name, pa.array(values[at]))
        return out

    return dealt.groupBy(*keys, "_br", "_bc").applyInArrow(one, shape)


def box_mean(df: DataFrame, columns: list[str], size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` replaced by their means over ``size`` x ``size`` pixels; pixels beyond the edge repeat the edge."""
    made = {f"_m{i}": "double" for i in range(len(columns))}
    out = over_blocks(df, columns, size // 2, made, lambda arrays, mean: [mean(a, size) for a in arrays], keys)
    return out.drop(*columns).withColumnsRenamed(dict(zip(made, columns))).select(df.columns)


def ssim(df: DataFrame, a: str, b: str, name: str = "ssim", size: int = 7, data_range: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the local structural similarity of two layers."""
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2

    def work(arrays: list[np.ndarray], mean: Callable) -> list[np.ndarray]:
        x, y = arrays
        mx, my, xx, yy, xy = (mean(v, size) for v in (x, y, x * x, y * y, x * y))
        top = (2 * mx * my + c1) * (2 * (xy - mx * my) + c2)
        den = (mx * mx + my * my + c1) * ((xx - mx * mx) + (yy - my * my) + c2)
        return [np.where(den == 0, 1.0, np.clip(top / np.where(den == 0, 1.0, den), -1.0, 1.0))]

    return over_blocks(df, [a, b], size // 2, {name: "double"}, work, keys)


def _windowed(value: np.ndarray, weight: np.ndarray, size: int, mean: Callable) -> np.ndarray:
    w, v = mean(weight, size), mean(value * weight, size)
    return np.where(w > 0.15, v / np.where(w > 0.15, w, 1.0), 0.0)


def windowed_mean(df: DataFrame, value: str, valid: str, size: int, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a layer over the valid pixels of a window; 0 where no more than 15 % of the window is valid."""
    flagged = df.withColumn("_w", F.coalesce(F.col(valid).cast("double"), F.lit(0.0)))
    return over_blocks(flagged, [value, "_w"], size // 2, {name: "double"}, lambda a, mean: [_windowed(a[0], a[1], size, mean)], keys).drop("_w")


def focus_scores(df: DataFrame, sizes: DataFrame, value: str = "score", zone: str = "zone", valid: str = "valid", keys: tuple[str, ...] = ()) -> DataFrame:
    """(zone, focus): the largest windowed mean in each zone, with the window of its own (``sizes``: zone, size; a few fixed sizes).

    All sizes are worked out on the same blocks, so the pixels move once however many sizes there are.
    """
    used = sorted(r["size"] for r in sizes.select("size").distinct().collect())  # at most the seven fixed sizes
    if not used:
        return sizes.select(zone, F.lit(None).cast("double").alias("focus")).limit(0)
    slim = df.select(*keys, "row", "col", zone, value, valid).withColumn("_w", F.coalesce(F.col(valid).cast("double"), F.lit(0.0)))
    made = {f"_f{size}": "double" for size in used}
    means = over_blocks(slim, [value, "_w"], used[-1] // 2, made, lambda a, mean: [_windowed(a[0], a[1], size, mean) for size in used], keys)
    peaks = means.where(F.col(zone).isNotNull() & F.col(valid)).groupBy(zone).agg(*[F.max(c).alias(c) for c in made])
    own = F.coalesce(*[F.when(F.col("size") == size, F.col(f"_f{size}")) for size in used])
    return peaks.join(sizes, zone).select(zone, own.alias("focus"))


def spread(df: DataFrame, flag: Column, radius: int, name: str, grow: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """A mask dilated (or eroded) by a square: where any pixel (or no pixel less than all) of the window has the flag."""
    size = 2 * radius + 1
    work = lambda a, mean: [mean(a[0], size) * size**2 > (0.5 if grow else size**2 - 0.5)]
    return over_blocks(df.withColumn("_flag", F.coalesce(flag.cast("double"), F.lit(0.0))), ["_flag"], radius, {name: "boolean"}, work, keys).drop("_flag")
